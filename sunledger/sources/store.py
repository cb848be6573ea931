"""Writers of a store folder: appends, keyed upserts, retention and compaction.

Files of a day are replaced in two steps that a later run can finish.  A rewriting job holds the table's lease, so there is one at
a time; others wait.  It stages the list of the files that it replaces and then the new files below the table; renaming that
folder to ``_pending`` is the commit, and it is refused unless the staged files are complete.  Publishing moves the new files in
and deletes the listed ones, and may stop anywhere: the next holder of the lease finishes it and drops what was only staged.
Appends take no lease and touch no staging folder; what they add is not listed, so it stays.  Readers of ``tables.read_table``
do not see a half-published table.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sunledger import KEY
from sunledger.operators.partials import BUCKET_TABLES, merge_buckets
from sunledger.schemas import TABLES
from sunledger.session import work_dir
from sunledger.sources.files import create_new, drop_folder, exists, fs_of, is_data, list_versions, names_in, read_small  # noqa: F401
from sunledger.sources.lease import Lease, rewriting
from sunledger.sources.tables import HIVE_NULL, PENDING, PUBLISHED, table_path

# Age limits.  Daily rollups and site energy never expire.
RAW_KEEP = dt.timedelta(days=90)
AGGREGATE_KEEP_MONTHS = 24
COMPACT_AFTER = dt.timedelta(days=7)
MARKER = "_compacted"
DAYS_PER_COMMIT = 16    # days of one compaction job; its lease is free between them
RAW_TABLES = ["inverter_samples", "inverter_phase_samples", "inverter_input_samples",
              "meter_samples", "meter_phase_samples", "message_rejects", *BUCKET_TABLES.values()]
AGGREGATE_TABLES = ["power_30sec", "power_5min"]
# Segment and time column of the tables that are compacted.
SEGMENTS = {
    "inverter_samples": (None, "time"), "inverter_phase_samples": ("phase_id", "time"),
    "inverter_input_samples": ("input_id", "time"), "meter_samples": (None, "time"),
    "meter_phase_samples": ("phase_id", "time"), "power_30sec": ("kind", "bucket"), "power_5min": ("kind", "bucket"),
    **{t: (None, "bucket") for t in BUCKET_TABLES.values()},
}
# Tables whose rows of one key become one row when their day is compacted.
MERGED = {t: partial(merge_buckets, kind=kind) for kind, t in BUCKET_TABLES.items()}
STAGING, REPLACED = "_staging-", "_replaced"
_fs = fs_of


def _balanced(df: DataFrame) -> DataFrame:
    """Few, evenly sized files per day: adaptive execution splits large days and merges small ones."""
    return df.hint("rebalance", "day")


def append_days(df: DataFrame, path: str) -> None:
    _balanced(df).write.mode("append").partitionBy("day").parquet(path)


def _in_days(days: list[dt.date | None]) -> Column:
    """Literal days, so that the scan lists and opens only their folders."""
    known = [d for d in days if d is not None]
    chosen = F.col("day").isin(known) if known else F.lit(False)
    return chosen | F.col("day").isNull() if len(known) < len(days) else chosen


def touched_days(df: DataFrame) -> list[dt.date | None]:
    """The days of a batch: as many as its time range has, however many rows."""
    return [r["day"] for r in df.select("day").distinct().collect()]


def _day_folder(day: dt.date | None) -> str:
    return HIVE_NULL if day is None else f"day={day.isoformat()}"


def _files(spark: SparkSession, path: str, days: list[dt.date | None]) -> list[str]:
    """Data files of these days, as day folder and name."""
    fs, root = _fs(spark, path)
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = []
    for name in map(_day_folder, days):
        folder = hpath(root, name)
        if fs.exists(folder):
            out += [f"{name}/{s.getPath().getName()}" for s in fs.listStatus(folder)
                    if not s.getPath().getName().startswith(("_", "."))]
    return out


def _read_files(spark: SparkSession, path: str, files: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(*(f"{path}/{f}" for f in files))


def recover(spark: SparkSession, path: str, wait: float | None = None) -> bool:
    """Finish what a dead run left of a rewrite; True if it had been committed."""
    with rewriting(spark, path, wait):
        return _finish(spark, path)


def _finish(spark: SparkSession, path: str) -> bool:
    """For the holder of the lease: publish a committed replacement, drop what was only staged."""
    fs, _ = fs_of(spark, path)
    for name in names_in(spark, path):
        if name.startswith(STAGING):
            drop_folder(spark, f"{path}/{name}")
    listed = read_small(spark, f"{path}/{PENDING}/{REPLACED}")
    if listed is None:
        drop_folder(spark, f"{path}/{PENDING}")
        return False
    replaced = [x for x in listed.split("\n") if x]
    move_days(spark, f"{path}/{PENDING}", path)
    for name in replaced:
        fs.delete(fs_of(spark, f"{path}/{name}")[1], False)
    for name in {x.split("/")[0] for x in replaced}:
        folder = f"{path}/{name}"
        fs.delete(fs_of(spark, f"{folder}/{MARKER}")[1], False)
        if not any(map(is_data, names_in(spark, folder))):  # a day that lost all its rows
            drop_folder(spark, folder)
    fs.delete(fs_of(spark, f"{path}/{PUBLISHED}")[1], False)
    create_new(spark, f"{path}/{PUBLISHED}", uuid.uuid4().hex)
    drop_folder(spark, f"{path}/{PENDING}")
    return True


def move_days(spark: SparkSession, source: str, path: str) -> None:
    """Move the data files of ``day`` folders into those of a table; files that were moved before are simply not there."""
    fs, _ = fs_of(spark, path)
    for day in [n for n in names_in(spark, source) if n.startswith("day=")]:
        fs.mkdirs(fs_of(spark, f"{path}/{day}")[1])
        for name in filter(is_data, names_in(spark, f"{source}/{day}")):
            target = fs_of(spark, f"{path}/{day}/{name}")[1]
            if not fs.rename(fs_of(spark, f"{source}/{day}/{name}")[1], target):
                raise OSError(f"cannot move {day}/{name} to {path}")


def rows_by_day(df: DataFrame) -> dict[dt.date | None, int]:
    """Counted from file footers where ``df`` is a plain scan."""
    return {r["day"]: r["count"] for r in df.groupBy("day").count().collect()}


def _commit(spark: SparkSession, path: str, lease: Lease, write: Callable[[str], None], replaced: list[str],
            complete: Callable[[dict], bool], schema) -> None:
    """Stage what ``write(folder)`` writes by day, commit it as the replacement of the listed files, and publish it.

    ``complete`` judges the staged rows by day.
    """
    fs, root = fs_of(spark, path)
    staging = f"{path}/{STAGING}{uuid.uuid4().hex}"
    try:
        create_new(spark, f"{staging}/{REPLACED}", "\n".join(replaced))
        write(staging)
        staged = names_in(spark, staging)
        if REPLACED not in staged or "_SUCCESS" not in staged or not complete(
                rows_by_day(spark.read.schema(schema).option("basePath", staging).parquet(staging))):
            raise OSError(f"staged files of {path} are not complete; nothing was replaced")
        lease.check()
    except BaseException:
        drop_folder(spark, staging)
        raise
    if not fs.rename(fs_of(spark, staging)[1], fs_of(spark, f"{path}/{PENDING}")[1]):
        raise OSError(f"cannot commit {staging}")
    _finish(spark, path)


def stored_rows(spark: SparkSession, path: str, new: DataFrame, cols: list[str]) -> DataFrame:
    """Stored ``cols`` of the days present in ``new``, read from the folders of those days alone."""
    stored = spark.read.schema(new.schema).parquet(path).where(_in_days(touched_days(new)))
    if "time" in new.columns:
        # Samples are appended in time order, so the range also skips row groups of a large day.
        span = new.agg(F.min("time").alias("lo"), F.max("time").alias("hi")).first()
        stored = stored.where(F.col("time").between(F.lit(span["lo"]), F.lit(span["hi"])))
    return stored.select(*cols, "day")


def insert_first(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose ``keys`` are not stored yet; an earlier row always wins.

    Only the key columns of the touched days are read.  Repeating a batch adds
    nothing, which makes a streaming retry harmless.
    """
    append_days(new_rows(spark, new, path, keys), path)


def new_rows(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` are not stored yet."""
    if not exists(spark, path):
        return new
    return new.join(stored_rows(spark, path, new, keys), [*keys, "day"], "left_anti")


def upsert_days(spark: SparkSession, new: DataFrame, path: str, keys: list[str] | None = None,
                drop: Column | None = None, days: list[dt.date] | None = None, wait: float | None = None) -> None:
    """Insert or replace rows by ``(keys, day)``; only the touched days are read and rewritten.

    Rows of those days that are not replaced are carried over, but for those for which ``drop`` holds.  ``days`` adds days to
    the touched ones.  A run that dies at any point can be repeated, and loses nothing: see the module's text.  Waits up to
    ``wait`` seconds for another rewriting job.
    """
    keys = keys or KEY
    incoming = work_dir(spark, "incoming")
    try:
        # ``new`` may be made from this table, and its days must be known: write it first.
        new.write.parquet(incoming)
        schema = new.schema
        new = spark.read.schema(schema).parquet(incoming)
        least = rows_by_day(new)
        with rewriting(spark, path, wait) as lease:
            _finish(spark, path)
            replaced = _files(spark, path, sorted({*least, *(days or [])}, key=str))
            rows = new
            if replaced:
                kept = _read_files(spark, path, replaced, schema).join(new.select(*keys, "day"), [*keys, "day"], "left_anti")
                rows = (kept if drop is None else kept.where(~F.coalesce(drop, F.lit(False)))).unionByName(new)
            _commit(spark, path, lease, lambda at: _balanced(rows).write.mode("append").partitionBy("day").parquet(at), replaced,
                    lambda staged: all(staged.get(d, 0) >= n for d, n in least.items()), schema)
    finally:
        drop_folder(spark, incoming)


def day_partitions(spark: SparkSession, path: str) -> list[dt.date]:
    """Days with a partition folder, from the folder listing alone."""
    fs, hpath = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(hpath)]
    return sorted(dt.date.fromisoformat(n[4:]) for n in names if n.startswith("day=") and n != HIVE_NULL)


def retention_cutoff(table: str, now: dt.datetime) -> dt.date | None:
    """First day kept, NULL when the table never expires; whole days only."""
    if table in RAW_TABLES:
        return (now - RAW_KEEP).date()
    if table in AGGREGATE_TABLES:
        months = now.year * 12 + now.month - 1 - AGGREGATE_KEEP_MONTHS
        year, month = divmod(months, 12)
        first_of_next = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
        last_day = (first_of_next - dt.timedelta(days=1)).day
        return dt.date(year, month + 1, min(now.day, last_day))
    return None


def expire(spark: SparkSession, path: str, cutoff: dt.date | None) -> list[dt.date]:
    """Drop the partitions that lie wholly before ``cutoff``; no data is read or rewritten."""
    if cutoff is None:
        return []
    with rewriting(spark, path):
        _finish(spark, path)    # a rewrite that is published later would bring days back
        gone = [d for d in day_partitions(spark, path) if d < cutoff]
        for day in gone:
            drop_folder(spark, f"{path}/day={day.isoformat()}")
    return gone


def apply_retention(spark: SparkSession, store: str, now: dt.datetime) -> dict[str, list[dt.date]]:
    """Retention over all tables of a store that exist."""
    return {
        t: expire(spark, table_path(store, t), retention_cutoff(t, now))
        for t in RAW_TABLES + AGGREGATE_TABLES if exists(spark, table_path(store, t))
    }


def _compacted(fs, folder) -> bool:
    """A day is done when its marker is newer than its data; a rewrite removes the marker."""
    files = {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(folder)}
    done = files.pop(MARKER, None)
    return done is not None and all(t <= done for t in files.values())


def compact(spark: SparkSession, path: str, now: dt.datetime, segment: str | None = None,
            after: dt.timedelta = COMPACT_AFTER, time: str = "time", schema=None, wait: float | None = None,
            merge: Callable[[DataFrame], DataFrame] | None = None) -> list[dt.date]:
    """Rewrite days older than ``after`` once, as sorted zstd files; the rows stay the same, or become those of ``merge``.

    Rows are ranged by (day, segment, device, time), so one device's or one
    day's bulk is spread over tasks and adaptive execution sizes the files;
    each covers a narrow range that its min/max statistics let scans skip.
    A backlog is worked off some days at a time, each group committed and
    marked by itself, with the lease free in between.  Rows appended while
    this runs are in files of their own and stay; the day is then due again.
    """
    fs, _ = fs_of(spark, path)
    cutoff = (now - after).date()
    order = [F.col(c) for c in ([segment] if segment else []) + KEY] + [F.col(time).desc()]
    with rewriting(spark, path, wait):
        _finish(spark, path)
    due = [d for d in day_partitions(spark, path) if d < cutoff and not _compacted(fs, fs_of(spark, f"{path}/{_day_folder(d)}")[1])]
    schema = schema or (spark.read.parquet(path).schema if due else None)
    for days in [due[i:i + DAYS_PER_COMMIT] for i in range(0, len(due), DAYS_PER_COMMIT)]:
        with rewriting(spark, path, wait) as lease:
            _finish(spark, path)
            replaced = _files(spark, path, days)
            if not replaced:    # expired meanwhile
                continue
            old = _read_files(spark, path, replaced, schema)
            old = merge(old) if merge else old
            _commit(spark, path, lease, lambda at: (
                old.repartitionByRange("day", *order).sortWithinPartitions("day", *order)
                .write.mode("append").option("compression", "zstd").partitionBy("day").parquet(at)), replaced,
                rows_by_day(old).__eq__, schema)
            for day in days:
                create_new(spark, f"{path}/{_day_folder(day)}/{MARKER}", "")
    return due


def apply_compaction(spark: SparkSession, store: str, now: dt.datetime) -> dict[str, list[dt.date]]:
    """Compaction over all sample and power tables of a store that exist, clustered by their segment column."""
    return {
        t: compact(spark, table_path(store, t), now, segment, time=time, schema=TABLES[t], merge=MERGED.get(t))
        for t, (segment, time) in SEGMENTS.items() if exists(spark, table_path(store, t))
    }
