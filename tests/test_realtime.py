"""The view over power tables: late samples, the refreshed end, refreshes of a range."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sunledger.operators.power import downsample, power_rows
from sunledger.plans import realtime as R
from sunledger.session import work_dir
from sunledger.sources import store as S, tables as T
from sunledger.sources.batches import commit_batch

DAY = dt.datetime(2024, 1, 10)
SPAN = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def samples(spark, rows):
    """(device, minutes after DAY, power) as meter samples."""
    df = spark.createDataFrame([("S", d, DAY + dt.timedelta(minutes=m), float(p)) for d, m, p in rows],
                               "site_id string, device_name string, time timestamp, power_active double")
    cols = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.to_date("time").alias("day") if f.name == "day"
            else F.lit(None).cast(f.dataType).alias(f.name) for f in T.TABLES["meter_samples"]]
    return df.select(*cols)


def store_late(spark, store, rows, number):
    new = samples(spark, rows)
    commit_batch(spark, store, "q", number, lambda: {
        "power_late": R.late_buckets(spark, store, power_rows(new, "meter")), "meter_samples": new})


def view(spark, store, table, span=SPAN):
    return sorted(map(tuple, R.power_realtime(spark, store, table, *span).collect()))


def whole(spark, store, table, span=SPAN):
    rows = power_rows(T.read_table(spark, store, "meter_samples"), "meter").where(F.col("time").between(*span))
    return sorted(map(tuple, downsample(rows, R.WIDTHS[table]).select(*R.AT, "avg_power", "min_power", "max_power").collect()))


def files_of(spark, store, table, day):
    return sorted(f for f in T.read_table(spark, store, table).inputFiles() if day in f)


@pytest.fixture
def store(spark):
    base = work_dir(spark, "realtime")
    S.append_days(samples(spark, [(d, m, m + 1) for d in ("a", "b") for m in (0, 1, 7, 59.6, 1445, 2890, 4000)]), f"{base}/meter_samples")
    return base


def test_without_a_refresh_all_is_aggregated_from_samples(spark, store):
    assert R.late_buckets(spark, store, power_rows(samples(spark, [("a", 0, 1)]), "meter")) is None
    for table in R.WIDTHS:
        assert view(spark, store, table) == whole(spark, store, table) and len(view(spark, store, table)) >= 10
    assert R.power_realtime(spark, work_dir(spark, "none"), "power_5min", *SPAN).collect() == []


def test_late_samples_show_at_once_and_are_refreshed_alone(spark, store):
    now = DAY + dt.timedelta(days=2, minutes=30)
    for table in R.WIDTHS:
        R.refresh_power_range(spark, store, table, now, dt.timedelta(days=9), dt.timedelta(minutes=10))
    assert R.refreshed_until(spark, store)["power_5min"] == DAY + dt.timedelta(days=2, minutes=20)
    before = {t: len(view(spark, store, t)) for t in R.WIDTHS}
    # in a stored bucket, in a new bucket of a stored day, past the refreshed end
    store_late(spark, store, [("a", 0.2, 100), ("b", 30, 5), ("a", 5000, 9)], 0)
    for table in R.WIDTHS:
        assert view(spark, store, table) == whole(spark, store, table) and len(view(spark, store, table)) == before[table] + 2
        part = DAY, DAY + dt.timedelta(minutes=50)
        assert view(spark, store, table, part) == whole(spark, store, table, part)
    stored = {t: files_of(spark, store, t, "day=2024-01-11") for t in R.WIDTHS}
    assert R.refresh_late(spark, store) == 2 and R.refresh_late(spark, store) == 0
    for table in R.WIDTHS:
        assert view(spark, store, table) == whole(spark, store, table)
        kept = T.read_table(spark, store, table)
        assert files_of(spark, store, table, "day=2024-01-11") == stored[table] != []     # another day is not rewritten
        assert kept.where(F.col("bucket") == DAY).where("device_name = 'a'").first().max_power == 100.0


def test_a_late_refresh_that_dies_is_repeated(spark, store, monkeypatch):
    for table in R.WIDTHS:
        R.refresh_power_range(spark, store, table, DAY + dt.timedelta(days=5), dt.timedelta(days=9), dt.timedelta(0))
    store_late(spark, store, [("a", 0.2, 100)], 0)
    real, calls = R.upsert_days, []

    def dies(*args, **more):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        real(*args, **more)

    monkeypatch.setattr(R, "upsert_days", dies)
    with pytest.raises(RuntimeError):
        R.refresh_late(spark, store)
    monkeypatch.undo()
    for table in R.WIDTHS:
        assert view(spark, store, table) == whole(spark, store, table)
    assert R.refresh_late(spark, store) == 1


def test_a_range_refresh_removes_buckets_without_samples_and_leaves_others(spark, store):
    R.refresh_power_range(spark, store, "power_5min", DAY + dt.timedelta(days=5), dt.timedelta(days=9), dt.timedelta(0))
    path = f"{store}/meter_samples"
    S.upsert_days(spark, samples(spark, []), path, ["time"], drop=F.col("time") < F.lit(DAY + dt.timedelta(minutes=2)), days=[DAY.date()])
    # 00:02 to 00:08 holds one whole bucket, which has a sample at 00:07; the bucket at 00:00 is only partly inside and stays
    R.refresh_power_range(spark, store, "power_5min", DAY + dt.timedelta(minutes=10), dt.timedelta(minutes=8), dt.timedelta(0))
    at = [r.bucket for r in T.read_table(spark, store, "power_5min").where("device_name = 'a'").orderBy("bucket").collect()]
    assert at[:2] == [DAY, DAY + dt.timedelta(minutes=5)]
    R.refresh_power_range(spark, store, "power_5min", DAY + dt.timedelta(minutes=10), dt.timedelta(minutes=10), dt.timedelta(0))
    assert view(spark, store, "power_5min") == whole(spark, store, "power_5min")
    assert R.refreshed_until(spark, store) == {"power_5min": DAY + dt.timedelta(days=5)}     # it does not go back
