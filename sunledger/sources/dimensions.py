"""Writers of the tables without days: device descriptors, rosters, site settings.

Every write makes a numbered snapshot from the one before, under the table's lease. A snapshot counts once it is finished, so a
run that dies leaves the table as it was, and readers keep the files they have listed. Older snapshots stay readable for a while.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger.operators.devices import site_upsert, sync_registry
from sunledger.operators.ordered import latest
from sunledger.operators.validation import registry_validate, rejected_rows, rule_sets
from sunledger.schemas import TABLES
from sunledger.sources.files import drop_folder, list_versions
from sunledger.sources.lease import rewriting
from sunledger.sources.tables import read_dimension, table_path

KEPT_SNAPSHOTS = 10


def write_dimension(spark: SparkSession, store: str, table: str, change: Callable[[DataFrame], DataFrame],
                    wait: float | None = None) -> int:
    """Make the next snapshot as ``change(newest)``; returns its number. Columns that ``change`` does not give are NULL."""
    path, schema = table_path(store, table), TABLES[table]
    with rewriting(spark, path, wait) as lease:
        versions = list_versions(spark, path)
        number = max(versions, default=0) + 1
        made = change(read_dimension(spark, store, table))
        made = made.select(*(F.col(f.name).cast(f.dataType) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name)
                             for f in schema))
        lease.check()
        made.hint("rebalance").write.mode("overwrite").parquet(f"{path}/version={number}")
        for old in versions[:-KEPT_SNAPSHOTS]:
            drop_folder(spark, f"{path}/version={old}")
    return number


def sync_registry_store(spark: SparkSession, store: str, configured: DataFrame, sites: DataFrame | None = None,
                        now: dt.datetime | None = None) -> DataFrame:
    """Replace the stored roster of the configured sites; returns the rows that break a rule.

    ``sites`` names the configured sites, so that one without devices is emptied. A site with a row that breaks a rule keeps
    its stored roster. Every row that is written gets ``updated_at`` = ``now``.
    """
    at = F.lit(now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp")
    rules = rule_sets()["device_registry"]
    faulty = registry_validate(configured).where(F.size("violations") > 0).select(*configured.columns, "violations").unionByName(
        rejected_rows(configured, rules).select(*configured.columns, "violations"))
    named = (configured if sites is None else sites).select("site_id").distinct().join(
        faulty.select("site_id").distinct(), "site_id", "left_anti")
    good = configured.join(named, "site_id", "left_semi").withColumn("updated_at", at)
    write_dimension(spark, store, "device_registry", lambda current: sync_registry(current, good, named))
    return faulty


def sync_site_store(spark: SparkSession, store: str, configured: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """Replace the stored settings of the configured sites; returns the rows that break a rule and were left out."""
    at = F.lit(now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp")
    faulty = rejected_rows(configured, rule_sets()["site"])
    good = configured.join(faulty.select("site_id").distinct(), "site_id", "left_anti")
    write_dimension(spark, store, "site", lambda current: site_upsert(current, good, at))
    return faulty


def keep_latest(spark: SparkSession, store: str, table: str, rows: DataFrame, keys: list[str], order: str = "seq") -> None:
    """Keep the newest row per key. A repeated batch changes nothing."""
    write_dimension(spark, store, table, lambda current: latest(current.unionByName(rows.select(current.columns)), keys, order))
