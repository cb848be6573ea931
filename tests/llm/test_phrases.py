import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sunledger.llm import phrases as P, tokens

RULES = P.PhraseRules(longest=4, least=3, top=12, scale=1000)


def pieces_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def brute(rows, rules):
    """rows: (text, lang). All phrases, every cut, all longer candidates."""
    by = collections.defaultdict(list)
    for text, lang in rows:
        by[lang or "und"] += pieces_of(text)
    out = []
    for lang, pieces in by.items():
        f, n = collections.Counter(), sum(map(len, pieces))
        for p in pieces:
            f.update(tuple(p[i:i + m]) for i in range(len(p)) for m in range(1, rules.longest + 1) if i + m <= len(p))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= rules.least}
        inner = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                 if j - i < len(p) and candidates[p[i:j]] <= a}
        scored = []
        for p, a in candidates.items():
            if p not in inner:
                score, _, l, r = min((rules.scale * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:rules.top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def corpus():
    rng = random.Random(7)
    vocabulary = ["the", "Of", "dog", "cat", "é", "日本", "x'y", "run"] + [f"w{i}" for i in range(30)]
    rows = []
    for lang in ("en", "de", None, "und"):
        for _ in range(60):
            words = rng.choices(vocabulary, [8, 6, 3, 3, 2, 2, 1, 1] + [0.2] * 30, k=rng.randint(0, 25))
            if rng.random() < 0.4:
                words[rng.randint(0, len(words)):0] = "New York City hall".split()[:rng.choice([2, 3, 4, 4])]
            rows.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) for w in words), lang))
    # few phrases, and those of rare words: everything has to be expanded
    rows += [("a b " * 40, "few"), ("one one one one one one", "one"), (None, "en"), ("", "de"), (" \t\n", "en"), ("lonely words here", "lonely")]
    rows += [rows[0]] * 3
    return rows


def test_like_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, w1 long, phrase string").repartition(5)
    got = sorted(map(tuple, P.mine_phrases(df, RULES).collect()))
    want = brute(rows, RULES)
    assert got == want and {g[0] for g in got} == {"en", "de", "und", "few", "one"}
    assert max(collections.Counter(g[0] for g in got).values()) == RULES.top     # some language is settled by its threshold


def test_no_phrases(spark):
    schema = "text string, lang string"
    assert P.mine_phrases(spark.createDataFrame([], schema), RULES).collect() == []
    assert P.mine_phrases(spark.createDataFrame([("a b c", "en"), (None, None)], schema), RULES).collect() == []


TEXTS = ["", None, "One two, three.Four\tfive", "   ", "ÀÉ A\x0bB\x0c C", "long " * 500 + ".", "x" * 3000, "end", "\x00 nul   sep",
         ". , ;", "last words"]


@pytest.mark.parametrize("size", [1 << 20, 64, 7])
def test_words_of(monkeypatch, size):
    monkeypatch.setattr(tokens, "SLICE", size)
    languages = [tokens.text_hash("en" if i % 2 else "de") for i in range(len(TEXTS))]
    for array in (pa.array(TEXTS), pa.array(["skipped", *TEXTS], pa.large_string())[1:]):
        got = collections.defaultdict(list)
        hashes = {}
        for words in tokens.words_of(array, languages):
            spelled = words.spelled(np.arange(len(words)))
            for i in range(len(words)):
                row = int(words.text[i])
                got[row].append((spelled[i], i > 0 and words.text[i - 1] == row and words.piece[i] == words.piece[i - 1]))
                assert hashes.setdefault((row % 2, spelled[i]), words.hash[i]) == words.hash[i]
        assert len(set(map(int, hashes.values()))) == len(hashes)
        for row, text in enumerate(TEXTS):
            assert got[row] == [(w, i > 0) for p in pieces_of(text) for i, w in enumerate(p)]


def test_phrase_hashes_and_neighbours():
    (words,) = tokens.words_of(pa.array(["a b c. a b c d", "a b"]), [tokens.text_hash("en")] * 2)
    at = words.within(np.arange(len(words)), 2)
    assert at.tolist() == [0, 1, 3, 4, 5, 7]
    g = words.phrase_hash(at, 2)
    assert g[0] == g[2] == g[5] and g[1] == g[3] and len(set(g.tolist())) == 3
    assert words.neighbour(np.array([0, 3]), -1).tolist() == [0, 0]
    assert words.neighbour(np.array([1, 2, 8]), 1).tolist() == [int(words.hash[2]), 0, 0]


def test_bitmap(spark):
    w1, w2 = tokens.mixed(np.arange(5000, dtype=np.uint64)), tokens.mixed(np.arange(9000, 14000, dtype=np.uint64))
    w2[::3] = 0
    rows = list(zip(w1.view(np.int64).tolist(), w2.view(np.int64).tolist()))
    bitmap = P._bitmap(spark.createDataFrame(rows, "w1 long, w2 long"), ["w1", "w2"], 5000)
    assert bitmap.has(np.where(w2 == 0, w1, tokens.chained(w1, w2))).all()
    assert bitmap.has(tokens.mixed(np.arange(20000, 40000, dtype=np.uint64))).mean() < 0.1


def test_words_at_the_edges_of_texts():
    """Words end with their text, whatever stands next to it in the batch; equal words have equal hashes."""
    import re

    import numpy as np
    import pyarrow as pa

    from sunledger.llm.tokens import words_of

    texts = ["a", "b", " a", "b ", "", None, ".", " ", "A b,c", "c\n", "\nc", "ab", "c;;a b", "\u00e9", "x" * 9, "a"]
    got, place, hashes = [], {}, {}
    for words in words_of(pa.array(texts), [np.uint64(5)] * len(texts)):
        data = words.data.tobytes()
        for s, e, h, p, t in zip(*(x.tolist() for x in (words.start, words.end, words.hash, words.piece, words.text))):
            word = data[s:e].lower().decode("utf-8")
            got.append((t, place.setdefault(p, len(place)), word))
            assert hashes.setdefault(word, h) == h
    want, pieces = [], 0
    for t, text in enumerate(texts):
        for piece in re.split("[.,;:!?\n-\r]", (text or "").lower()):
            if words := re.findall("[^ \t]+", piece):
                want += [(t, pieces, w) for w in words]
                pieces += 1
    assert got == want and len(set(hashes.values())) == len(hashes)


def test_runs_of_frequent_words(spark):
    """Levels scan runs of frequent words that were written once; other words and breaks are gaps."""
    rows = [("a b rare c, a B;b  c\nrare", "en"), ("b rare", "de"), (None, "en"), ("rare", "en"), ("c a", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    [words] = tokens.words_of(pa.array(["a b c"]), [tokens.text_hash("en")])
    spelled = dict(zip(words.hash.tolist(), "abc"))
    held = np.zeros(1 << 17, np.uint8)
    for h in spelled:
        held[h >> 47] |= 1 << (h >> 44 & 7)

    class Frequent:
        value = P.Bitmap(held, 20)

    [row] = P._runs(docs, Frequent).collect()
    [(words, _)] = P._kept_slices([pa.RecordBatch.from_arrays([pa.array([bytes(row.payload)])], names=["payload"])])
    runs = collections.defaultdict(str)
    for piece, h in zip(words.piece.tolist(), words.hash.tolist()):
        runs[piece] += spelled[h]
    assert list(runs.values()) == ["ab", "c", "ab", "bc", "ca"]
    path = P._Rounds(spark, docs, P.PhraseRules(least=2)).runs.inputFiles()[0]
    assert "/runs/" in path
