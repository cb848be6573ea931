"""Chunked operators against brute force, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from sunledger.operators import ordered

KEYS = ["k"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    keys = ["hot"] * 6 + ["a", "b"]
    return [(rng.choice(keys), seq, rng.choice(["x", "y", None]), rng.random() < 0.2) for seq in range(600)]


@pytest.mark.parametrize("chunk_rows", [7, 100, 10_000])
def test_repeats_are_dropped_per_key(spark, rows, chunk_rows):
    last, want = {}, set()
    for k, seq, v, _ in rows:
        if k not in last or last[k] != v:
            want.add(seq)
        last[k] = v
    df = spark.createDataFrame(rows, "k string, seq long, v string, d boolean")
    once = ordered.change_gate(df, KEYS, "seq", ["v"], chunk_rows)
    assert {r.seq for r in once.collect()} == want
    again = ordered.change_gate(once, KEYS, "seq", ["v"], chunk_rows)
    assert {r.seq for r in again.collect()} == want
    assert once.columns == df.columns


@pytest.mark.parametrize("chunk_rows", [5, 10_000])
def test_asof_takes_the_latest_descriptor(spark, rows, chunk_rows):
    known, want = {}, {}
    for k, seq, v, is_device in rows:
        if is_device:
            known[k] = (seq,)
        else:
            want[seq] = known.get(k)
    df = spark.createDataFrame(rows, "k string, seq long, v string, d boolean").withColumn("at", F.col("seq"))
    got = ordered.device_asof(df.where("NOT d").drop("at"), df.where("d"), KEYS, "seq", ["at"], chunk_rows)
    assert {r.seq: tuple(r.descriptor) if r.descriptor else None for r in got.collect()} == want


def test_first_wins_keeps_one_of_many_copies(spark):
    rows = [("hot", 1, seq, float(seq)) for seq in range(1000, 1500)] + [("a", t, t, 0.0) for t in range(5)]
    df = spark.createDataFrame(rows, "k string, t long, seq long, v double")
    got = {(r.k, r.t): r.seq for r in ordered.first_wins(df, ["k", "t"]).collect()}
    assert got == {("hot", 1): 1000, **{("a", t): t for t in range(5)}}


def test_latest_takes_the_newest_row_with_its_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 5, "z")], "k string, seq long, v string")
    assert {tuple(r) for r in ordered.latest(df, KEYS, "seq").collect()} == {("a", 2, None), ("b", 5, "z")}


def test_repeats_of_messages(spark):
    rows = [("t", p, s) for s, p in enumerate("AABBA")]
    df = spark.createDataFrame(rows, "topic string, payload string, seq long")
    assert sorted(r.seq for r in ordered.suppress_repeats(df, chunk_rows=2).collect()) == [0, 2, 4]


def test_sparse_sequence_numbers_give_the_same_result(spark):
    rows = [("a", i * 1_000_003, v) for i, v in enumerate("xxyyxzzzyx")] + [("b", 5, "x"), ("b", 6_000_000_000, "x")]
    sparse = spark.createDataFrame(rows, "k string, seq long, v string")
    dense = spark.createDataFrame([(k, i, v) for i, (k, _, v) in enumerate(rows)], "k string, seq long, v string")
    for chunk_rows in (2, 3, 100):
        kept = ordered.change_gate(sparse, ["k"], "seq", ["v"], chunk_rows)
        assert sorted((r.k, r.v) for r in kept.collect()) == sorted(
            (r.k, r.v) for r in ordered.change_gate(dense, ["k"], "seq", ["v"], 1000).collect())


def chunk_sizes(spark, df, chunk_rows):
    bounds = ordered.chunk_bounds(df, ["k"], "seq", chunk_rows)
    return sorted(r["count"] for r in ordered._chunked(df, ["k"], "seq", bounds).groupBy("k", "_chunk").count().where("k = 'hot'").collect())


@pytest.mark.parametrize("numbers", ["dense", "large", "outlier", "bursts", "negative"])
def test_no_chunk_is_much_larger_than_asked_for(spark, numbers):
    n, chunk_rows, i = 8000, 1000, F.col("id")
    seq = {"dense": i, "large": i + 5_000_000_000_000_000_000, "outlier": F.when(i == 0, -1).otherwise(i + 9_000_000_000_000_000_000),
           "bursts": (i % 8) * 1_000_000_007 + F.floor(i / 8), "negative": -i * 3}[numbers]
    df = spark.range(n).select(F.lit("hot").alias("k"), seq.cast("long").alias("seq")).union(
        spark.range(50).select(F.lit("cold"), "id"))
    sizes = chunk_sizes(spark, df, chunk_rows)
    assert sum(sizes) == n and max(sizes) <= 1.5 * chunk_rows and len(sizes) >= 7
    assert ordered.chunk_bounds(df, ["k"], "seq", n) is None


@pytest.mark.parametrize("chunk_rows", [3, 40])
def test_outliers_bursts_nulls_and_ties(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    rows = [(None, s, rng.choice("xy")) for s in (-5, 10 ** 18, *range(0, 400, 7))]
    rows += [("t", s // 3, rng.choice("xy")) for s in range(200)]      # three rows of one number
    rows += [("big", 10 ** 17 + rng.randint(0, 50) * 10 ** 9 + s, rng.choice(["x", None])) for s in range(150)]
    df = spark.createDataFrame(rows, "k string, seq long, v string")
    plain = ordered.with_previous(df, ["k"], "seq", ["v"], 10 ** 6).collect()
    cut = ordered.with_previous(df, ["k"], "seq", ["v"], chunk_rows).collect()
    assert sorted(map(str, plain)) == sorted(map(str, cut)) and len(cut) == len(rows)
    known = spark.createDataFrame([(k, s, f"{k}{s}") for k, s, _ in rng.sample(rows, 40)], "k string, seq long, f string")
    got = [sorted(map(str, ordered.device_asof(df, known, ["k"], "seq", ["f"], c).collect())) for c in (10 ** 6, chunk_rows)]
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_instants_as_order(spark):
    rows = spark.range(100).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 86400).alias("at"), (F.col("id") / 10).cast("int").alias("v"))
    assert ordered.change_gate(rows, ["k"], "at", ["v"], 7).count() == 10


def test_reads_of_the_input(spark, tmp_path):
    """Two narrow reads for the bounds, one of all columns: the operator's own plan has a single scan of the rows."""
    spark.range(5000).select((F.col("id") % 2).alias("k"), "id", F.lit("v").alias("v")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = ordered.change_gate(df, ["k"], "id", ["v"], 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
    known = df.where("id % 50 = 0")
    plan = ordered.device_asof(df.where("id % 50 <> 0"), known, ["k"], "id", ["v"], 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3
