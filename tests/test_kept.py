"""Kept day buckets: merged batches equal one pass over all samples, and rollups of the store read no raw sample."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from sunledger import KEY
from sunledger.operators import partials as P
from sunledger.operators.counters import day_buckets
from sunledger.operators.power import power_column
from sunledger.plans import kept
from sunledger.plans.rollup import run_site_rollup
from sunledger.session import work_dir
from sunledger.sources import fleet, store as S, tables as T
from sunledger.sources.batches import commit_batch
from sunledger.streaming import ingest as SI

FIRST, LAST = dt.date(2024, 6, 10), dt.date(2024, 6, 11)
ROLLUPS = ("power_30sec", "power_5min", "inverter_daily", "meter_daily", "site_energy")


@pytest.fixture(scope="module")
def samples(spark):
    """Both kinds, a sample a minute and every fifth minute three, some without counter or power."""
    base, second = work_dir(spark, "fleet"), F.unix_seconds("time")
    thin = (second % 60 == 0) | (second % 300 < 9)
    holes = {"inverter": ["ac_energy"], "meter": ["energy_active_export"]}
    for kind, df in (("inverter", fleet.inverter_samples(spark, 2, FIRST, 2)), ("meter", fleet.meter_samples(spark, 2, FIRST, 2))):
        for c in holes[kind]:
            df = df.withColumn(c, F.when(F.col("seq") % 7 != 0, F.col(c)))
        power = power_column(kind)
        df.where(thin).withColumn(power, F.when(F.col("seq") % 11 != 0, F.col(power))).write.partitionBy("day").parquet(f"{base}/{kind}")
    return {kind: spark.read.schema(T.TABLES[f"{kind}_samples"]).parquet(f"{base}/{kind}") for kind in P.COUNTERS}


def new_store(spark, name):
    store = work_dir(spark, name)
    fleet.registry(spark, 2).write.parquet(f"{store}/device_registry")
    fleet.site_numbers(spark, 2).drop("scenario").write.parquet(f"{store}/site")
    return store


def rollups(spark, store):
    """Stored rows; sums over buckets, added up in any order, to nine decimals."""
    def read(table):
        df = T.read_table(spark, store, table)
        return sorted(map(str, df.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes)).collect()))

    return {t: read(t) for t in ROLLUPS}


@pytest.mark.parametrize("tz", ["Europe/Berlin", "Asia/Kathmandu", "America/St_Johns"])
def test_merged_parts_equal_one_pass(spark, samples, tz):
    for kind, df in samples.items():
        parts = [P.partial_buckets(df.where(F.col("seq") % 4 == i), kind) for i in range(4)]
        stored = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
        got = P.local_buckets(stored, kind, FIRST, LAST, tz)
        want = day_buckets(df, P.COUNTERS[kind], tz, 30, power_column(kind)).where(F.col("day").between(F.lit(FIRST), F.lit(LAST)))
        want = want.select(got.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and stored.count() > got.count() > 0


def test_rollups_of_kept_buckets_read_no_sample(spark, samples, monkeypatch):
    plain, store = new_store(spark, "plain"), new_store(spark, "kept")
    for kind, df in samples.items():
        S.append_days(df, f"{plain}/{kind}_samples")
        S.append_days(df.where("seq % 3 = 0"), f"{store}/{kind}_samples")
    run_site_rollup(spark, plain, FIRST, LAST, fleet.TZ)
    assert kept.start_buckets(spark, store) == list(P.BUCKET_TABLES.values()) and kept.start_buckets(spark, store) == []

    def rows(part):
        both = {kind: df.where(F.col("seq") % 3 == part) for kind, df in samples.items()}
        return {**{t: x for kind, df in both.items() for t, x in kept.kept_rows(spark, store, kind, df).items()},
                **{f"{kind}_samples": df for kind, df in both.items()}}

    assert commit_batch(spark, store, "q", 0, lambda: rows(1))
    assert not commit_batch(spark, store, "q", 0, lambda: rows(1))     # a retry counts nothing twice
    run_site_rollup(spark, store, FIRST, LAST, fleet.TZ)
    assert rollups(spark, store) != rollups(spark, plain)
    assert commit_batch(spark, store, "q", 1, lambda: rows(2))
    monkeypatch.setattr(T, "read_local_days", lambda *a: pytest.fail("raw samples were read"))
    run_site_rollup(spark, store, FIRST, LAST, fleet.TZ)
    assert rollups(spark, store) == rollups(spark, plain)
    # Compaction merges the rows of a bucket, expiry takes them with the samples; results stay.
    path = T.table_path(store, "meter_buckets")
    before = T.read_table(spark, store, "meter_buckets").count()
    S.apply_compaction(spark, store, dt.datetime(2024, 7, 1))
    after = T.read_table(spark, store, "meter_buckets")
    assert after.count() == after.select(*KEY, "bucket").distinct().count() < before
    run_site_rollup(spark, store, FIRST, LAST, fleet.TZ)
    assert rollups(spark, store) == rollups(spark, plain)
    S.apply_retention(spark, store, dt.datetime(2024, 6, 11) + S.RAW_KEEP)
    assert all(d >= FIRST for d in S.day_partitions(spark, path)) and S.day_partitions(spark, path)


def test_rows_that_come_next_to_a_merge_stay(spark, samples, monkeypatch):
    """A batch that is stored while its days are merged is merged the next time."""
    store = new_store(spark, "race")
    df = samples["meter"]
    S.append_days(df.where("seq % 2 = 0"), f"{store}/meter_samples")
    kept.start_buckets(spark, store)
    real, late = S._commit, [P.partial_buckets(df.where("seq % 2 = 1"), "meter")]

    def commit(s, path, *rest):
        while late:
            S.append_days(late.pop(), path)
        real(s, path, *rest)

    monkeypatch.setattr(S, "_commit", commit)
    path = T.table_path(store, "meter_buckets")

    def run():
        return S.compact(spark, path, dt.datetime(2024, 7, 1), time="bucket", schema=T.TABLES["meter_buckets"], merge=S.MERGED["meter_buckets"])

    n = df.count()
    assert run() and T.read_table(spark, store, "meter_buckets").agg(F.sum("n")).first()[0] == n
    S.append_days(P.partial_buckets(df.limit(0), "meter"), path)
    for day in S.day_partitions(spark, path):       # files of the same second as the marker
        os.utime(f"{path}/day={day}/{S.MARKER}", (0, 0))
    assert run()
    merged = T.read_table(spark, store, "meter_buckets")
    assert merged.agg(F.sum("n")).first()[0] == n and merged.count() == merged.select(*KEY, "bucket").distinct().count()


def test_ingest_adds_its_share_once(spark):
    from tests.test_streaming import AT, meter_batch
    store = work_dir(spark, "ingest")
    assert kept.kept_rows(spark, store, "meter", None) == {}            # a store that keeps none
    kept.start_buckets(spark, store)
    second = dt.timedelta(seconds=1)
    first = meter_batch(spark, ((1, AT, 5.0), (2, AT + 40 * second, 6.0)))
    for number in (0, 0):
        SI.store_readings(first, store, "meter", "q", number)
    # A stored reading that comes again adds nothing; a late one changes its bucket's first value.
    SI.store_readings(meter_batch(spark, ((3, AT, 9.0), (4, AT + 20 * second, 5.5), (5, AT + 31 * second, 5.75))), store, "meter", "q", 1)
    rows = P.merge_buckets(T.read_table(spark, store, "meter_buckets"), "meter").orderBy("bucket").collect()
    assert [(r.n, r.power_sum, r.energy_active_import_v0, r.energy_active_import_v1) for r in rows] == [(2, 10.5, 5.0, 5.5), (2, 11.75, 5.75, 6.0)]
    assert T.read_table(spark, store, "meter_samples").count() == 4
