import random

import numpy as np

from sunledger.llm import jaccard_join as J

from .conftest import ODD


def grams(text):
    w = (text or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    link = [[a != b and bool(x) and 5 * len(x & y) >= 4 * len(x | y) for b, y in enumerate(sets)] for a, x in enumerate(sets)]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[a], *(root[b] for b in range(len(rows)) if link[a][b])], key=lambda k: rows[k][0]) for a in range(len(rows))]
    return sorted((rows[a][0], rows[root[a]][0], sum(link[a])) for a in range(len(rows)))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


def near_rows():
    rng = random.Random(2)
    rows = []
    for g in range(6):
        base = [f"w{g}x{rng.randint(0, 500)}" for _ in range(120)]
        rows += [(100 * g + i, edited(rng, base, rng.choice([0, 1, 1, 2, 4]))) for i in range(12)]
    return rows + [(900, "one two"), (901, "one two"), (902, "one  two"), (903, ""), (904, ""), (905, None)]


def test_against_brute_force(documents, monkeypatch):
    monkeypatch.setattr(J, "TILE", 4)       # groups of twelve take several tiles
    rows = near_rows()
    out = sorted((r.doc_id, r.class_id, r.n_links) for r in J.join_report(documents(rows)).collect())
    assert out == brute(rows)


def test_one_of_each_class_stays(documents):
    rows = near_rows()
    kept = sorted(r.doc_id for r in J.one_of_each(documents(rows)).collect())
    assert kept == sorted({c for _, c, _ in brute(rows)})


def test_odd_rows(documents):
    out = sorted(((r.doc_id, r.n_links) for r in J.join_report(documents(ODD)).collect()), key=str)
    assert (4, 1) in out and (4, 0) in out and len(out) == len(ODD)
    assert J.join_report(documents([])).count() == 0
    assert J.one_of_each(documents(ODD)).count() == len(ODD) - 1     # the repeated row
    named = documents(ODD).toDF("doc_id", "text", "_k1", "_id", "_text")
    assert J.one_of_each(named).columns == named.columns and J.one_of_each(named).count() == len(ODD) - 1


def test_banding_reaches_the_recall():
    bands, rows = J.bands_for(0.8)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9999
    rng = np.random.default_rng(1)
    found = 0
    for _ in range(200):
        x = rng.integers(0, 1 << 62, 90, np.uint64)
        a, b = np.unique(x[:81]), np.unique(np.r_[x[:72], x[81:]])      # 72 of 90
        found += bool((J.signature(a, bands, rows) == J.signature(b, bands, rows)).any())
    assert found >= 199


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 3), (-5, 100)], "a long, b long")
    got = {r.node: r.root for r in J.components(edges).collect()}
    assert {got[i] for i in range(10)} == {-5} and got[25] == 20 and got[39] == 30
