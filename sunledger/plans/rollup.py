"""Daily rollups end to end: devices, then sites.

The ``compute_*`` functions take any range of days of all sites at once.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger import KEY
from sunledger.functions.solar import daylight_calendar, site_days
from sunledger.functions.timeutil import day_spine, in_local_days
from sunledger.operators import daily as D
from sunledger.operators.counters import day_buckets
from sunledger.operators.partials import BUCKET_TABLES, COUNTERS, local_buckets
from sunledger.operators.power import POWER_30SEC, POWER_5MIN, power_column, power_from_buckets
from sunledger.operators.site import site_energy
from sunledger.session import work_dir
from sunledger.sources import tables as T
from sunledger.sources.store import drop_folder, exists, upsert_days


@dataclass(frozen=True)
class Thresholds:
    """Limits of the quality flags and the bucket they count."""

    inverter_coverage_min: float = D.INVERTER_COVERAGE_MIN
    meter_coverage_min: float = D.METER_COVERAGE_MIN
    continuity_min: float = D.CONTINUITY_MIN
    bucket_seconds: int = D.BUCKET_SECONDS


def compute_inverter_energy(samples: DataFrame, spine: DataFrame, sites: DataFrame | None, tz: str,
                            limits: Thresholds = Thresholds()) -> DataFrame:
    """Inverter days, judged against the daylight of their site where it has coordinates."""
    calendar = None
    if sites is not None:
        calendar = daylight_calendar(site_days(sites, spine.select("site_id", "day").distinct()), tz)
    return D.inverter_daily(samples, spine, calendar, tz, limits.inverter_coverage_min,
                            limits.continuity_min, limits.bucket_seconds)


def compute_meter_energy(samples: DataFrame, spine: DataFrame, tz: str, limits: Thresholds = Thresholds()) -> DataFrame:
    return D.meter_daily(samples, spine, tz, limits.meter_coverage_min, limits.continuity_min, limits.bucket_seconds)


def compute_site_energy(inverter_days: DataFrame, meter_days: DataFrame, power: DataFrame, registry: DataFrame,
                        days: DataFrame, tz: str, limits: Thresholds = Thresholds()) -> DataFrame:
    return site_energy(inverter_days, meter_days, power, registry, days, tz, limits.bucket_seconds)


def _bucketed(samples: DataFrame, kind: str, tz: str, seconds: int) -> DataFrame:
    return day_buckets(samples, COUNTERS[kind], tz, seconds, power_column(kind))


def _written(spark: SparkSession, buckets: dict[str, DataFrame], scratch: str | None) -> dict[str, DataFrame]:
    """Day buckets per kind.

    With ``scratch`` both kinds are written there in one job, so that the
    several results made from them do not each rebuild them.
    """
    if scratch is None:
        return buckets
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  (df.withColumn("kind", F.lit(kind)) for kind, df in buckets.items()))
    both.write.mode("overwrite").partitionBy("kind").parquet(f"{scratch}/buckets")
    stored = spark.read.schema(both.schema).parquet(f"{scratch}/buckets")
    return {kind: stored.where(F.col("kind") == kind).drop("kind") for kind in buckets}


def compute_site_rollup(inverter_samples: DataFrame, meter_samples: DataFrame, registry: DataFrame, sites: DataFrame,
                        spine: DataFrame, tz: str, limits: Thresholds = Thresholds(),
                        scratch: str | None = None) -> dict[str, DataFrame]:
    """Device rollups, power and the site balance over ``spine`` (site_id, device_name, kind, day).

    Raw samples are scanned and shuffled once, into day buckets; everything else
    is made from those.  With ``scratch`` (a folder shared by all executors)
    they are written there, so no result has to rebuild them.  Devices come from
    the spine, the balance from the roster: a device taken off the roster keeps
    its own daily rows.
    """
    spark, seconds = spine.sparkSession, limits.bucket_seconds
    samples = {"inverter": inverter_samples, "meter": meter_samples}
    buckets = _written(spark, {kind: _bucketed(df, kind, tz, seconds) for kind, df in samples.items()}, scratch)
    inverter, meter = buckets["inverter"], buckets["meter"]
    days = spine.select("site_id", "day").distinct()
    calendar = daylight_calendar(site_days(sites, days), tz)
    inverters = D.inverter_days(inverter, spine.where("kind = 'inverter'"), calendar, tz,
                                limits.inverter_coverage_min, limits.continuity_min, seconds)
    meters = D.meter_days(meter, spine.where("kind = 'meter'"), tz,
                          limits.meter_coverage_min, limits.continuity_min, seconds)
    power = power_from_buckets(inverter, "inverter", seconds, seconds).unionByName(
        power_from_buckets(meter, "meter", seconds, seconds))
    site = compute_site_energy(inverters, meters, power, registry, days, tz, limits)
    return {"inverter_daily": inverters, "meter_daily": meters, "power": power, "site_energy": site}


def refresh_power(spark: SparkSession, store: str, first: dt.date, last: dt.date, tz: str) -> None:
    """Rebuild both power resolutions of a range of local days from stored samples."""
    scratch = work_dir(spark, "power")
    try:
        _write_power(spark, store, _stored_buckets(spark, store, first, last, tz, scratch))
    finally:
        drop_folder(spark, scratch)


def _stored_buckets(spark: SparkSession, store: str, first: dt.date, last: dt.date, tz: str, scratch: str,
                    only: DataFrame | None = None) -> dict[str, DataFrame]:
    """Day buckets of a range of local days: kept ones where the store has them (see ``kept``), else made from samples."""
    def chosen(rows: DataFrame) -> DataFrame:
        return rows if only is None else rows.join(only.select("site_id").distinct(), "site_id", "left_semi")

    def read(kind: str) -> DataFrame:
        table, kept = f"{kind}_samples", BUCKET_TABLES[kind]
        if exists(spark, T.table_path(store, kept)):
            return local_buckets(chosen(T.read_table(spark, store, kept)), kind, first, last, tz)
        if exists(spark, T.table_path(store, table)):
            return _bucketed(chosen(T.read_local_days(spark, store, table, first, last, tz)), kind, tz, D.BUCKET_SECONDS)
        return _bucketed(spark.createDataFrame([], T.TABLES[table]), kind, tz, D.BUCKET_SECONDS)  # a fleet may have only one kind

    return _written(spark, {kind: read(kind) for kind in COUNTERS}, scratch)


def _write_power(spark: SparkSession, store: str, buckets: dict[str, DataFrame]) -> None:
    for table, seconds in (("power_30sec", POWER_30SEC), ("power_5min", POWER_5MIN)):
        rows = reduce(DataFrame.unionByName, (power_from_buckets(df, kind, seconds, D.BUCKET_SECONDS) for kind, df in buckets.items()))
        upsert_days(spark, rows.withColumn("day", F.to_date("bucket")), T.table_path(store, table), [*KEY, "bucket"])


def run_site_rollup(spark: SparkSession, store: str, first: dt.date, last: dt.date, tz: str,
                    only: DataFrame | None = None) -> None:
    """Power, device and site rollups of a range of local days over a store.

    Raw samples of the range are read once, into 30-second day buckets in the
    shared folder, or not at all where the store keeps such buckets; every table is written before the next step reads it, and
    every step replaces rows by key, so a run can be repeated at any point.
    Devices are those of the roster and those with samples in the range.
    ``only`` (site_id, day) limits it to those days of those sites.
    """
    registry, sites = T.read_dims(spark, store)
    scratch = work_dir(spark, "rollup")
    try:
        buckets = _stored_buckets(spark, store, first, last, tz, scratch, only)
        _write_power(spark, store, buckets)
        devices = registry.select(*KEY, "kind")
        for kind, df in buckets.items():
            devices = devices.unionByName(df.select(*KEY, F.lit(kind).alias("kind")))
        spine = day_spine(devices.distinct(), first, last)
        days = day_spine(registry.select("site_id").distinct(), first, last)
        if only is not None:
            spine, days = (df.join(only, ["site_id", "day"], "left_semi") for df in (spine, days))
        limits = Thresholds()
        inverters = D.inverter_days(
            buckets["inverter"], spine.where("kind = 'inverter'"),
            daylight_calendar(site_days(sites, spine.select("site_id", "day").distinct()), tz), tz,
            limits.inverter_coverage_min, limits.continuity_min, limits.bucket_seconds)
        upsert_days(spark, inverters.drop("notes"), T.table_path(store, "inverter_daily"))
        meters = D.meter_days(buckets["meter"], spine.where("kind = 'meter'"), tz,
                              limits.meter_coverage_min, limits.continuity_min, limits.bucket_seconds)
        upsert_days(spark, meters.drop("notes"), T.table_path(store, "meter_daily"))

        between = F.col("day").between(F.lit(first), F.lit(last))
        balance = compute_site_energy(
            T.read_table(spark, store, "inverter_daily").where(between),
            T.read_table(spark, store, "meter_daily").where(between),
            in_local_days(_power_days(spark, store, first, last), first, last, tz, "bucket"), registry, days, tz)
        upsert_days(spark, balance.where("written").drop("written", "notes"), T.table_path(store, "site_energy"), ["site_id"])
    finally:
        drop_folder(spark, scratch)


def _power_days(spark: SparkSession, store: str, first: dt.date, last: dt.date) -> DataFrame:
    one = dt.timedelta(days=1)
    return T.read_table(spark, store, "power_30sec").where(
        F.col("day").between(F.lit(first - one), F.lit(last + one)))
