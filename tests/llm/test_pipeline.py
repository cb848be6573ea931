"""Every stage against brute force on its own input, and the whole run."""

import random

import corpus_pipeline as C
from sunledger.llm import quality
from sunledger.session import work_dir

from . import test_jaccard, test_line_dedup, test_suffix_dedup


def corpus():
    rng = random.Random(8)
    line = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.randint(0, 400)}" for _ in range(n)) + "."
    passage = line(60)
    rows = [(i, "\n".join(line(rng.randint(9, 20)) for _ in range(4))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]                                     # exact copies
    rows += [(200 + i, rows[i][1].replace(".\n", f" e{i}.\n", 1)) for i in range(5)]      # a word more
    rows += [(300 + i, f"{line(10)}\n{line(5)[:-1]} {passage} {line(7)}") for i in range(3)]
    return rows + [(400, "Home | News | About | Contact | Imprint | More\n" * 3), (401, None), (402, "short")]


def test_stages_against_brute_force(spark, documents):
    docs, sf_dir = documents(corpus()), "unused"
    for name, stage in C.STAGES[:-1]:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        at = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        out = spark.read.parquet(at)
        assert out.columns == docs.columns
        got = {r.doc_id: r.text for r in out.collect()}
        assert all(r.n_chars == len(r.text) for r in out.collect())
        if name == "quality_rules":
            want = {i: j["clean"] for i, t in rows if (j := quality.judge(t))["kept"]}
        elif name == "line_dedup":
            want = {i: t for i, t in test_line_dedup.brute(rows).items() if t.split()}
            assert not set(range(100, 105)) & want.keys() and set(range(40)) <= want.keys()
        elif name == "ngram_jaccard_join":
            kept = {c for _, c, _ in test_jaccard.brute(rows)}
            want = {i: t for i, t in rows if i in kept}
        else:
            want = {i: n_left for i, _, n_left in ((i, n, n - gone) for i, n, gone, *_ in test_suffix_dedup.brute(rows)) if n_left}
            got = {i: len(t.encode()) for i, t in got.items()}
            assert got[300] > got[301] and got[300] > got[302]
        assert got == want, name
        docs = out
    packed = C.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_run_and_empty_table(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
