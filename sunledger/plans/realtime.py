"""Power buckets that are always up to date.

A power table is refreshed up to some instant. What came after it is aggregated from the samples when it is read; so are buckets
before it that got late samples, which the ingest notes in ``power_late``. ``refresh_late`` makes those buckets anew, and them
alone, and takes their notes away.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger import KEY
from sunledger.functions.timeutil import time_bucket
from sunledger.operators.power import POWER_30SEC, POWER_5MIN, bucket_range, downsample, power_rows
from sunledger.schemas import TABLES
from sunledger.sources import tables as T
from sunledger.sources.dimensions import write_dimension
from sunledger.sources.files import exists, fs_of
from sunledger.sources.store import _files, _read_files, day_partitions, touched_days, upsert_days

WIDTHS = {"power_30sec": POWER_30SEC, "power_5min": POWER_5MIN}
AT = [*KEY, "kind", "bucket"]


def refreshed_until(spark: SparkSession, store: str) -> dict[str, dt.datetime]:
    """Up to where each power table is refreshed (UTC); tables that never were are not in it."""
    rows = T.read_dimension(spark, store, "power_progress").select("name", F.date_format("until", "yyyy-MM-dd HH:mm:ss").alias("until")).collect()
    return {r["name"]: dt.datetime.fromisoformat(r["until"]) for r in rows}     # one row a table


def late_buckets(spark: SparkSession, store: str, samples: DataFrame) -> DataFrame | None:
    """Rows of ``power_late`` for samples (site_id, device_name, kind, time) that are about to be stored; None if none can be late."""
    until = refreshed_until(spark, store)
    if not until:
        return None
    late = samples.where(F.col("time") < F.lit(max(until.values())).cast("timestamp"))
    return late.select(*KEY, "kind", time_bucket("time", POWER_5MIN).alias("bucket")).distinct().withColumn("day", F.current_date())


def _power_rows(spark: SparkSession, store: str, first: dt.datetime, stop: dt.datetime) -> DataFrame | None:
    rows = [power_rows(T.read_samples(spark, store, f"{kind}_samples", first, stop), kind)
            for kind in ("inverter", "meter") if exists(spark, T.table_path(store, f"{kind}_samples"))]
    return reduce(DataFrame.unionByName, rows) if rows else None


def _days(first: dt.datetime, stop: dt.datetime) -> list[dt.date]:
    last = (stop - dt.timedelta(microseconds=1)).date()
    return [first.date() + dt.timedelta(days=i) for i in range((last - first.date()).days + 1)]


def refresh_power_range(spark: SparkSession, store: str, table: str, now: dt.datetime,
                        start_offset: dt.timedelta, end_offset: dt.timedelta) -> None:
    """Make the buckets of a power table anew that lie wholly inside [now - start_offset, now - end_offset].

    Buckets whose samples are gone are removed; only the days of the range are read and rewritten.  ``now`` is UTC.  The table
    counts as refreshed up to the end of the range afterwards.
    """
    first, stop = bucket_range(WIDTHS[table], now, start_offset, end_offset)
    if first >= stop:
        return
    rows = _power_rows(spark, store, first, stop)
    fresh = spark.createDataFrame([], TABLES[table]) if rows is None else downsample(rows, WIDTHS[table]).withColumn("day", F.to_date("bucket"))
    at = [F.lit(t).cast("timestamp") for t in (first, stop)]
    upsert_days(spark, fresh, T.table_path(store, table), [*KEY, "bucket"],
                drop=(F.col("bucket") >= at[0]) & (F.col("bucket") < at[1]), days=_days(first, stop))
    done = spark.range(1).select(F.lit(table).alias("name"), at[1].alias("until"))
    write_dimension(spark, store, "power_progress", lambda known: known.unionByName(done).groupBy("name").agg(F.max("until").alias("until")))


def _anew(spark: SparkSession, store: str, late: DataFrame, width: int) -> DataFrame | None:
    """Buckets of ``width`` inside the five-minute buckets of ``late``, from the samples of their days alone."""
    days = sorted(d for d in touched_days(late.select(F.to_date("bucket").alias("day"))) if d)
    if not days:
        return None
    rows = _power_rows(spark, store, dt.datetime.combine(days[0], dt.time()), dt.datetime.combine(days[-1], dt.time()) + dt.timedelta(days=1))
    if rows is None:
        return None
    rows = rows.where(F.to_date("time").isin(days))
    of = rows.withColumn("_of", time_bucket("time", POWER_5MIN))
    mine = late.select(*KEY, "kind", F.col("bucket").alias("_of"))
    return downsample(of.join(mine, [*KEY, "kind", "_of"], "left_semi"), width)


def _late(spark: SparkSession, store: str) -> tuple[DataFrame | None, list[str]]:
    """Noted buckets, each once, and the files that note them."""
    path = T.table_path(store, "power_late")
    files = _files(spark, path, day_partitions(spark, path)) if exists(spark, path) else []
    return (_read_files(spark, path, files, TABLES["power_late"]).select(*AT).distinct() if files else None), files


def refresh_late(spark: SparkSession, store: str) -> int:
    """Make the buckets anew that got late samples; returns how many five-minute buckets there were.

    Only the samples of their days are read, and only the days that hold them are rewritten.  Notes are taken away once both
    tables are written, those that come meanwhile stay; a run that dies is repeated as a whole.
    """
    late, files = _late(spark, store)
    if late is None:
        return 0
    late = late.persist()
    try:
        for table, until in refreshed_until(spark, store).items():
            fresh = _anew(spark, store, late.where(F.col("bucket") < F.lit(until).cast("timestamp")), WIDTHS[table])
            if fresh is not None:
                upsert_days(spark, fresh.withColumn("day", F.to_date("bucket")), T.table_path(store, table), [*KEY, "bucket"])
        n = late.count()
    finally:
        late.unpersist()
    path = T.table_path(store, "power_late")
    fs, _ = fs_of(spark, path)
    for name in files:
        fs.delete(fs_of(spark, f"{path}/{name}")[1], False)
    return n


def power_realtime(spark: SparkSession, store: str, table: str, first: dt.datetime, stop: dt.datetime) -> DataFrame:
    """Buckets of [first, stop) as if the table had been refreshed just now.

    Stored buckets before the refreshed end, but for those with late samples, and an aggregation of the samples of the rest.
    """
    width, until = WIDTHS[table], refreshed_until(spark, store).get(table)
    edge = first if until is None else min(max(until, first), stop)
    parts = []
    if until is not None and first < edge:
        bounds = [F.lit(t).cast("timestamp") for t in (first, edge)]
        stored = T.read_table(spark, store, table).where(
            F.col("day").between(F.lit(first.date()), F.lit(edge.date())) & (F.col("bucket") >= bounds[0]) & (F.col("bucket") < bounds[1])).drop("day")
        late, _ = _late(spark, store)
        if late is not None:
            late = late.where((F.col("bucket") >= time_bucket(bounds[0], POWER_5MIN)) & (F.col("bucket") < bounds[1]))
            marks = late.select(*KEY, "kind", F.col("bucket").alias("_of"))
            stored = stored.withColumn("_of", time_bucket("bucket", POWER_5MIN)).join(marks, [*KEY, "kind", "_of"], "left_anti").drop("_of")
            fresh = _anew(spark, store, late, width)
            if fresh is not None:
                parts.append(fresh.where((F.col("bucket") >= bounds[0]) & (F.col("bucket") < bounds[1])))
        parts.append(stored)
    if edge < stop:
        rows = _power_rows(spark, store, edge, stop)
        if rows is not None:
            parts.append(downsample(rows, width))
    cols = [*AT, "avg_power", "min_power", "max_power"]
    return reduce(DataFrame.unionByName, (p.select(cols) for p in parts)) if parts else spark.createDataFrame([], TABLES[table]).select(cols)
