import hashlib
import random

import numpy as np

from sunledger.llm import suffix_dedup as S

from .conftest import ODD


def brute(rows, length=50):
    first, out = {}, []
    key = lambda i: -1 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first[b[k:k + length]] = min(first.get(b[k:k + length], 1 << 62), key(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < key(i):
                gone[k:k + length] = [True] * length
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_every_difference_is_covered():
    assert (S._OFFSET < S.PERIOD).all()
    text = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=3000)) * 2, np.uint8)
    words = S.words_at(text)
    places = np.arange(len(text) - 64)
    order = S.sort_suffixes(words, places, S.cover_ranks(words)).places
    data = text.tobytes()
    assert [data[p:p + 50] for p in order] == sorted(data[p:p + 50] for p in places)


def test_against_brute_force(documents, small_blocks):
    rng = random.Random(7)
    base = ["".join(rng.choice("abé \n") for _ in range(rng.randint(40, 300))) for _ in range(6)]
    rows = []
    for i in range(80):
        text = ""
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            text += b[rng.randint(0, len(b)):][:rng.randint(0, 250)] + "x" * rng.choice([0, 0, 70]) + str(rng.random())
        rows.append((i, text))
    rows += [(100, "ab" * 300), (101, "ab" * 200), (102, "ab" * 24), (103, "ab" * 25), (5, rows[6][1]), (None, rows[8][1])]
    assert sorted(map(tuple, S.repeat_report(documents(rows)).collect()), key=str) == brute(rows)


def test_longer_strings_against_brute_force(documents, small_blocks):
    rng = random.Random(11)
    same = "".join(rng.choice("ab") for _ in range(100))   # many strings that differ only after 64 bytes
    tails = ["".join(rng.choice("cd") for _ in range(150)) for _ in range(12)]
    rows = [(i, same + rng.choice(tails) + str(i)) for i in range(60)]
    assert sorted(map(tuple, S.repeat_report(documents(rows), 200).collect()), key=str) == brute(rows, 200)
    text = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    starts, data = np.arange(len(text) - 199), text.tobytes()
    ids, least = np.arange(len(starts)), {}
    for s in starts.tolist():
        least.setdefault(data[s:s + 200], s)
    assert S.smallest_elsewhere(text, starts, ids, 200).tolist() == [least[data[s:s + 200]] for s in starts.tolist()]


def test_odd_rows_and_other_columns(documents):
    assert sorted(map(tuple, S.repeat_report(documents(ODD)).collect()), key=str) == brute(ODD)
    assert S.repeat_report(documents([])).count() == 0
    docs = documents([(1, "shared " * 10 + "one"), (2, "shared " * 10 + "two"), (3, None)]).toDF("doc_id", "text", "_block", "c1", "payload")
    assert S.remove_repeats(docs).columns == docs.columns
    out = {r.doc_id: r.text for r in S.remove_repeats(docs).collect()}
    assert out == {1: "shared " * 10 + "one", 2: "two", 3: None}
