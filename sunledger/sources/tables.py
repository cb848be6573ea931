"""Readers of a store folder: one Parquet table per name, partitioned by UTC ``day``."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger.functions.timeutil import in_local_days
from sunledger.schemas import DIMENSIONS, TABLES
from sunledger.sources.files import exists, fs_of, list_versions, read_small
from sunledger.sources.lease import POLL, TableBusy

PENDING, PUBLISHED = "_pending", "_published"
HIVE_NULL = "day=__HIVE_DEFAULT_PARTITION__"
PATIENCE = 60.0     # for a replacement that is being published


def table_path(store: str, table: str) -> str:
    return f"{store.rstrip('/')}/{table}"


def _published(spark: SparkSession, path: str) -> str | None:
    """Which replacement was published last; None while one is under way."""
    fs, pending = fs_of(spark, f"{path}/{PENDING}")
    return None if fs.exists(pending) else read_small(spark, f"{path}/{PUBLISHED}") or ""


def read_table(spark: SparkSession, store: str, table: str) -> DataFrame:
    """A table as it stands between two replacements of its files.

    Files are listed here.  Should one be gone when the rows are read, Spark fails and the read is repeated with a new listing.
    """
    if table in DIMENSIONS:
        return read_dimension(spark, store, table)
    path, until = table_path(store, table), time.monotonic() + PATIENCE
    while True:
        before = _published(spark, path)
        if before is not None:
            df = spark.read.schema(TABLES[table]).parquet(path)
            if _published(spark, path) == before:
                return df
        if time.monotonic() > until:
            raise TableBusy(f"{path}: a replacement was left half published; recover() finishes it")
        time.sleep(POLL)


def read_dimension(spark: SparkSession, store: str, table: str, version: int | None = None, at: dt.datetime | None = None) -> DataFrame:
    """The newest snapshot of a table without days, or the newest up to ``version`` or up to the instant ``at`` (UTC).

    A folder without numbered snapshots is read as it is, as the state before the first; a missing one is empty.
    """
    path = table_path(store, table)
    fs, _ = fs_of(spark, path)

    def finished(v: int) -> dt.datetime:
        done = fs.getFileStatus(fs_of(spark, f"{path}/version={v}/_SUCCESS")[1]).getModificationTime()
        return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=done)

    kept = [v for v in list_versions(spark, path) if (version is None or v <= version) and (at is None or finished(v) <= at)]
    if kept:
        return spark.read.schema(TABLES[table]).parquet(f"{path}/version={kept[-1]}")
    if exists(spark, path):
        return spark.read.schema(TABLES[table]).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false").parquet(
            path) if not list_versions(spark, path) else spark.createDataFrame([], TABLES[table])
    return spark.createDataFrame([], TABLES[table])


def read_samples(spark: SparkSession, store: str, table: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Samples with ``start <= time < end`` (UTC).

    The ``day`` bounds are spelled out: they prune partitions, the ``time``
    bounds are pushed into the row groups of what is left.
    """
    df = read_table(spark, store, table)
    last = (end - dt.timedelta(microseconds=1)).date()
    return df.where(
        F.col("day").between(F.lit(start.date()), F.lit(last))
        & (F.col("time") >= F.lit(start).cast("timestamp")) & (F.col("time") < F.lit(end).cast("timestamp")))


def read_local_days(spark: SparkSession, store: str, table: str, first: dt.date, last: dt.date, tz: str) -> DataFrame:
    """Samples of local days ``first`` .. ``last``; a zone is at most a day off UTC."""
    one = dt.timedelta(days=1)
    df = read_table(spark, store, table).where(F.col("day").between(F.lit(first - one), F.lit(last + one)))
    return in_local_days(df, first, last, tz)


def read_dims(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """Registry and site tables.  Their file sizes let the planner decide on a broadcast."""
    return read_table(spark, store, "device_registry"), read_table(spark, store, "site")
