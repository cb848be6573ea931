import random

from sunledger.llm import line_dedup as D

from .conftest import ODD


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or len(a) < D.NEAR_WORDS:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    lines = sorted((i, n, line) for i, t in set(rows) if t is not None for n, line in enumerate(t.split("\n")) if line.split())
    gone = set()
    for k, (i, n, line) in enumerate(lines):
        if any(line == o[2] or near(line.split(), o[2].split()) for o in lines[:k]):
            gone.add((i, n))
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def edit(rng, words):
    words = list(words)
    at, kind = rng.randrange(len(words)), rng.randrange(3)
    words[at:at + (kind < 2)] = [f"n{rng.randint(0, 9)}"] * (kind != 1)
    return words


def test_against_brute_force(documents):
    rng = random.Random(4)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(rng.choice([3, 8, 9, 12, 30]))] for _ in range(12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 5)):
            words = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                words = edit(rng, words)
            text.append(rng.choice([" ", "  "]).join(words))
        rows.append((i, "\n".join([*text, ""])))
    assert {r.doc_id: r.text for r in D.line_dedup(documents(rows)).collect()} == brute(rows)


def test_a_word_repeated_next_to_itself(documents):
    line = "a a a b c d e f g h"
    rows = [(1, line), (2, "a a b c d e f g h"), (3, "a a a a b c d e f g h"), (4, "a a a b c d e f h g")]
    assert {r.doc_id: r.text for r in D.line_dedup(documents(rows)).collect()} == {1: line, 2: "", 3: "", 4: rows[3][1]}


def test_odd_rows_and_columns(documents):
    for names in (["first", "words", "lang"], ["_id", "_hash", "_near"], ["_row", "_no", "_n_lines"]):
        docs = documents(ODD).toDF("doc_id", "text", *names)
        out = D.line_dedup(docs)
        kept = [c for c in docs.columns if c != "_n_lines"]
        assert out.count() == len(ODD) and out.columns == [*kept, "_n_lines", "_n_exact", "_n_near"]
        rows = out.collect()
        texts = {(r.doc_id, r.text) for r in rows}
        assert (1, None) in texts and (2, "") in texts and (4, "same text twice\nin two rows") in texts
        assert {r[2] for r in rows if r.text} == {"en"}
    assert D.line_report(documents([])).count() == 0
