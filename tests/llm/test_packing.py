import itertools
import random

import hypothesis
import pytest
from hypothesis import strategies as st

from sunledger.llm import packing as P
import public_tokenizers

from .conftest import ODD


@hypothesis.given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=5), st.integers(0, 60))
@hypothesis.settings(max_examples=300, deadline=None)
def test_fullest_combination(counts, room):
    got = P.fullest(counts, room)
    sums = {sum(n * l for n, l in zip(ns, counts)) for ns in itertools.product(*(range(c + 1) for c in counts.values()))}
    assert all(n <= counts[length] for length, n in got.items())
    assert sum(n * length for length, n in got.items()) == max(s for s in sums if s <= room)


def test_repeated_bins_equal_bins_made_one_by_one():
    rng = random.Random(3)
    counts = {rng.randint(1, 50): rng.randint(1, 9) for _ in range(20)}
    left, single = dict(counts), []
    while left:
        seed = max(left)
        bin_ = P.fullest({n: c - (n == seed) for n, c in left.items() if c > (n == seed)}, 50 - seed)
        bin_[seed] = bin_.get(seed, 0) + 1
        single.append(tuple(sorted(bin_.items())))
        left = {n: c - bin_.get(n, 0) for n, c in left.items() if c > bin_.get(n, 0)}
    plan = [tuple(sorted(b.items())) for times, b in P.bin_plan(counts, 50) for _ in range(times)]
    assert sorted(plan) == sorted(single)


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def test_every_piece_has_its_place(spark):
    rng = random.Random(5)
    rows = [(i, 0, rng.choice([3, 3, 3, 10, rng.randint(1, 10)])) for i in range(2000)] + [(None, 0, 4), (7, 0, 4), (7, 0, 4)]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long").repartition(5), 10, ["doc_id", "piece"]).collect()
    assert len(out) == len(rows)
    check_sequences(out, 10)
    assert len({r.sequence_id for r in out}) <= 1.05 * sum(r[2] for r in rows) / 10    # three threes leave one over


def test_columns_of_any_name(spark):
    names = ["doc_id", "length", "_part", "_rank", "_start", "offset"]
    pieces = spark.createDataFrame([(i, 1 + i % 3, i, i, -i, -1) for i in range(30)], names)
    out = P.pack(pieces, 6, ["doc_id"])
    assert out.columns == ["doc_id", "length", "_part", "_rank", "_start", "sequence_id", "offset"]
    rows = out.collect()
    assert all((r["_part"], r["_rank"], r["_start"]) == (r.doc_id, r.doc_id, -r.doc_id) for r in rows)
    check_sequences(rows, 6)
    assert len({r.sequence_id for r in rows}) == 10


def test_words_encoded_together_equal_words_alone(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(P, "CACHED", 20)
    with open(path, "rb") as file:
        ids = P.WordIds(file.read())
    rng = random.Random(2)
    words = ["<|endoftext|>", "a<|endoftext|>b", "<|", "<", "|>", "<|x", "", "\n", "e\u0301", "\u0301", "don't", "...", "x" * 300, "日本語"]
    texts = [" ".join(rng.choice(words + [f"w{rng.randint(0, 99)}"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    tokenizer = Tokenizer.from_file(path)
    for x in range(0, 60, 7):
        want = [b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(w, add_special_tokens=False).ids) for w in texts[x:x + 7]]
        assert ids(texts[x:x + 7]) == want
    ids._mark = None
    assert ids(texts[:7] + ["never seen"])[-1] == b"".join(
        i.to_bytes(4, "little") for i in tokenizer.encode("never seen", add_special_tokens=False).ids)


def test_plain_texts_are_split_as_the_tokenizer_does(monkeypatch):
    """Pieces of plain texts go to the model alone; texts with any other character, or an added token, as before."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(P, "CACHED", 200)
    with open(path, "rb") as file:
        ids = P.WordIds(file.read())
    tokenizer, rng = Tokenizer.from_file(path), random.Random(4)
    plain = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)] + list("''sStTdDmMlLrReEvV  \n")
    odd = [*plain, *map(chr, range(0x180)), "\u0301", "\u03a3", "\u0130", "\u1e9e", "\u2028", "<|endoftext|>"]

    def text(letters):
        return "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))

    def want(texts):
        return [b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]

    for _ in range(100):
        texts = [text(rng.choice([plain, odd])) for _ in range(10)] + ["a<|endoftext|>b", "I'LL don't'S 12 stra\u00dfe \u00c9T\u00c9", ""]
        assert ids(texts) == want(texts)
    monkeypatch.setattr(ids, "_tokenizer", None)    # its normalizer and splitting are not needed for plain texts
    texts = [text(plain) for _ in range(20)] + ["words that were not seen so far", "d\u00e9j\u00e0-vu, 42!"]
    assert ids(texts) == want(texts)


def test_values_of_keys_that_came_lately(monkeypatch):
    """Keys come one after another with repeats, without a set made of them first."""
    monkeypatch.setattr(P, "CACHED", 3)
    recent = P.Recent()
    assert sorted(recent.unknown(iter("abcaabd"))) == ["a", "b", "c", "d"]
    recent.values.update((k, k.encode()) for k in "abcd")
    assert recent.unknown(iter("aaxbx")) == ["x"] and recent.values == {"a": b"a", "b": b"b"}
    recent.values.update((k, k.encode()) for k in "xy")
    assert sorted(recent.unknown(iter("acb"))) == ["c"] and recent.values == {"a": b"a", "b": b"b"}


def test_bad_lengths_and_nothing(spark):
    schema = "doc_id long, length long"
    assert P.pack(spark.createDataFrame([], schema), 10, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([(1, 11)], schema), 10, ["doc_id"])


def test_documents_are_cut_only_where_too_long(spark, documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    out = P.pack_documents(spark, documents(ODD), path, capacity=512, ids=True).collect()
    check_sequences(out, 512)
    for i, t in ODD:
        whole = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted((r.start, r.piece, list(r.ids)) for r in out if r.doc_id == i)
        if i != 4:
            assert [x for *_, ids in pieces for x in ids] == whole
            assert [(start, k) for start, k, _ in pieces] == [(512 * k, k) for k in range(len(pieces))]
        else:
            assert [0, 0, whole] in list(map(list, pieces)) and len(pieces) == 3
    assert P.pack_documents(spark, documents([]), path).count() == 0
