import collections
import zlib

from pyspark.sql import functions as F

from sunledger.llm import sharding as H

from .conftest import ODD


def test_neighbours_on_the_curve_are_neighbours_in_the_grid(spark):
    bits = 3
    cells = spark.range(1 << 3 * bits).select(*(F.expr(f"int((id div {1 << bits * k}) % {1 << bits})").alias(f"x{k}") for k in range(3)))
    rows = sorted((r.h, r.x0, r.x1, r.x2) for r in cells.withColumn(
        "h", H.hilbert_index([F.col(f"x{k}") for k in range(3)], bits)).collect())
    assert [r[0] for r in rows] == list(range(1 << 3 * bits))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:])) == 1 for p, q in zip(rows, rows[1:]))


def shards(docs):
    by = collections.defaultdict(list)
    for r in H.shard_documents(docs).collect():
        by[r.shard].append(r)
    return by


def test_rows_law(documents):
    rows = [(i, "word " * (i % 90)) for i in range(1000)]
    by = shards(documents(rows))
    assert sorted(by) == list(range(24)) and {len(v) for v in by.values()} <= {41, 42}
    for rows_ in by.values():
        assert sorted(r.slot for r in rows_) == list(range(len(rows_)))
    spread = [max(r.curve for r in by[k]) - min(r.curve for r in by[k]) for k in by]
    ends = [(min(r.curve for r in by[k]), max(r.curve for r in by[k])) for k in sorted(by)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:])) and max(spread) < 4096


def test_odd_rows(documents):
    out = [r for v in shards(documents(ODD)).values() for r in v]
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted(
        (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert len({(r.shard, r.slot) for r in out}) == len(ODD) and {r.law for r in out} == {"rows"}
    assert H.shard_documents(documents([])).count() == 0
