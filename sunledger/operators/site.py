"""Whole-site daily balance from device rollups and bucketed power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sunledger import KEY
from sunledger.functions.timeutil import local_day
from sunledger.operators.power import POWER_30SEC

# Locations and diagnostics of a site-day.
FEED_IN = "feed-in"
CONSUMPTION = "consumption"
NO_PRIMARY = "no primary meter"
GRID_MISSING = "grid meter row missing"
CONSUMPTION_MISSING = "consumption meter row missing"
NO_INVERTERS = "no inverters configured"
NO_POWER = "no power data for day"
INCOMPLETE = "incomplete: "

SITE_DAY = ["site_id", "day"]


def registry_join(rows: DataFrame, registry: DataFrame, kind: str) -> DataFrame:
    """Rows of roster members of one kind.  No hint: the registry's file size decides on a broadcast."""
    members = registry.where(F.col("kind") == kind).select(*KEY)
    return rows.join(members, KEY, "left_semi")


def primary_meter_lookup(registry: DataFrame) -> DataFrame:
    """One row per site: its primary meter and location, NULL when it has none."""
    is_primary = (F.col("kind") == "meter") & F.col("is_primary")
    return registry.groupBy("site_id").agg(
        F.min(F.when(is_primary, F.struct("device_name", "location"))).alias("p")
    ).select(
        "site_id",
        F.col("p.device_name").alias("primary_meter"),
        F.col("p.location").alias("primary_location"),
        F.when(F.col("p.location").isNull(), F.lit(NO_PRIMARY)).alias("notes"),
    )


def contributors(registry: DataFrame) -> DataFrame:
    """Inverters UNION ALL the primary meter of each site, with their role and order in reports.

    Both parts live in one roster, so the union is one filter.
    """
    located = primary_meter_lookup(registry).where(F.col("primary_location").isNotNull()).drop("notes")
    inverter = F.col("kind") == "inverter"
    chosen = (F.col("kind") == "meter") & (F.col("device_name") == F.col("primary_meter"))
    return registry.select(*KEY, "kind").join(located, "site_id", "left").where(inverter | chosen).select(
        *KEY, F.when(inverter, "inverter").otherwise("primary").alias("role"),
        F.when(inverter, 0).otherwise(1).alias("ord"), "primary_location")


def inverter_union(power: DataFrame) -> DataFrame:
    """All inverters' buckets of all sites: one filter, since they share a table."""
    return power.where(F.col("kind") == "inverter")


def device_days(inverter_days: DataFrame, meter_days: DataFrame) -> DataFrame:
    """Inverter and meter rollups under one schema."""
    return inverter_days.select(
        *KEY, "day", "produced_kwh", "complete", "continuous"
    ).unionByName(
        meter_days.select(*KEY, "day", "imported_kwh", "exported_kwh", "complete", "continuous"),
        allowMissingColumns=True,
    )


def contributor_left_join(roster_days: DataFrame, days: DataFrame) -> DataFrame:
    """Contributor x day LEFT JOIN rollups; a missing row fails both flags."""
    return roster_days.join(days, [*KEY, "day"], "left").withColumns({
        "complete": F.coalesce("complete", F.lit(False)),
        "continuous": F.coalesce("continuous", F.lit(False)),
    })


def site_production(inverter_days: DataFrame, registry: DataFrame) -> DataFrame:
    """Produced energy per site-day over roster inverters; a NULL adds nothing."""
    return registry_join(inverter_days, registry, "inverter").groupBy(*SITE_DAY).agg(
        F.coalesce(F.sum("produced_kwh"), F.lit(0.0)).alias("production_kwh"))


def pv_power_by_bucket(power: DataFrame, registry: DataFrame, tz: str | Column) -> DataFrame:
    """Non-negative PV power per (site, day, bucket), summed over roster inverters."""
    return (
        registry_join(inverter_union(power), registry, "inverter")
        .groupBy("site_id", local_day("bucket", tz).alias("day"), "bucket")
        .agg(F.sum(F.greatest("avg_power", F.lit(0.0))).alias("pw"))
    )


def overlap_full_join(power: DataFrame, roster: DataFrame, tz: str | Column) -> DataFrame:
    """PV power and primary-meter power side by side per (site, day, bucket).

    A full outer join on the bucket, done as one conditional aggregation: both
    sides live in the same table, so it is scanned and shuffled once, combined
    map-side, and no bucket can be lost to either side.  ``roster`` is the
    result of :func:`contributors`.
    """
    clamped = F.greatest("avg_power", F.lit(0.0))
    return (
        power.join(roster.select(*KEY, "role"), KEY)
        .groupBy("site_id", local_day("bucket", tz).alias("day"), "bucket")
        .agg(
            F.coalesce(F.sum(F.when(F.col("role") == "inverter", clamped)), F.lit(0.0)).alias("pw"),
            F.coalesce(F.sum(F.when(F.col("role") == "primary", clamped)), F.lit(0.0)).alias("cw"),
        )
    )


def self_consumption_overlap(overlap: DataFrame, bucket_seconds: int = POWER_30SEC) -> DataFrame:
    """Estimated self-consumption and the number of buckets per site-day."""
    return overlap.groupBy(*SITE_DAY).agg(
        F.count(F.lit(1)).alias("n_buckets"),
        (F.sum(F.least("pw", "cw")) * F.lit(float(bucket_seconds)) / 3600.0 / 1000.0).alias("overlap_kwh"),
    )


def quality(contributor_days: DataFrame) -> DataFrame:
    """AND of both flags over the contributors of each site-day."""
    return contributor_days.groupBy(*SITE_DAY).agg(
        F.bool_and("complete").alias("complete"), F.bool_and("continuous").alias("continuous"))


def _incomplete() -> Column:
    names = F.collect_list(F.when(~F.col("complete"), F.struct("ord", "device_name")))
    listed = F.array_join(F.transform(F.array_sort(names), lambda x: x["device_name"]), ", ")
    return F.when(F.size(names) > 0, F.concat(F.lit(INCOMPLETE), listed))


def incomplete_list(contributor_days: DataFrame) -> DataFrame:
    """Names that hold a site-day back: inverters by name, the primary meter last."""
    return contributor_days.groupBy(*SITE_DAY).agg(_incomplete().alias("notes"))


def site_energy(
    inverter_days: DataFrame,
    meter_days: DataFrame,
    power: DataFrame,
    registry: DataFrame,
    site_spine: DataFrame,
    tz: str | Column,
    bucket_seconds: int = POWER_30SEC,
) -> DataFrame:
    """Balance of every (site, day) of ``site_spine``.

    ``written`` is false for days that end early with a note; such rows are
    reported, never stored, so an earlier stored row stays.  Contributor rows
    are joined once and yield production, meter totals, flags and names in one
    aggregation; power is read only for sites metered in the consumption path.
    """
    roster = contributors(registry)
    joined = contributor_left_join(
        roster.join(site_spine.select(*SITE_DAY), "site_id"), device_days(inverter_days, meter_days))
    primary = F.col("role") == "primary"
    per_day = joined.groupBy(*SITE_DAY).agg(
        F.coalesce(F.sum("produced_kwh"), F.lit(0.0)).alias("prod"),
        F.max(F.when(primary, F.col("imported_kwh"))).alias("imported"),
        F.max(F.when(primary, F.col("exported_kwh"))).alias("exported"),
        F.count_if(~primary).alias("n_inverters"),
        F.bool_and("complete").alias("complete"),
        F.bool_and("continuous").alias("continuous"),
        F.max("primary_location").alias("primary_location"),
        _incomplete().alias("incomplete"),
    )
    simulated = roster.where(F.col("primary_location") == CONSUMPTION)
    overlap = self_consumption_overlap(overlap_full_join(power, simulated, tz), bucket_seconds)

    df = site_spine.select(*SITE_DAY).join(per_day, SITE_DAY, "left").join(overlap, SITE_DAY, "left")
    measured = F.col("primary_location") == FEED_IN
    early = (
        F.when(F.col("primary_location").isNull(), NO_PRIMARY)
        .when(measured, F.when(F.col("imported").isNull() | F.col("exported").isNull(), GRID_MISSING))
        .when(F.col("imported").isNull(), CONSUMPTION_MISSING)
        .when(F.col("n_inverters") == 0, NO_INVERTERS)
        .when(F.coalesce("n_buckets", F.lit(0)) == 0, NO_POWER)
    )
    df = df.withColumn("early", early).withColumn(
        "self_kwh",
        F.when(measured, F.greatest(F.col("prod") - F.col("exported"), F.lit(0.0)))
        .otherwise(F.least(F.coalesce("overlap_kwh", F.lit(0.0)), "prod", "imported")),
    )
    written = F.col("early").isNull()
    cons = F.when(measured, F.col("self_kwh") + F.col("imported")).otherwise(F.col("imported"))

    def kept(c: Column) -> Column:
        return F.when(written, c)

    return df.select(
        *SITE_DAY,
        kept(F.col("prod")).alias("production_kwh"),
        kept(cons).alias("consumption_kwh"),
        kept(F.col("self_kwh")).alias("self_consumption_kwh"),
        kept(F.when(measured, F.col("imported")).otherwise(F.col("imported") - F.col("self_kwh"))).alias("from_grid_kwh"),
        kept(F.when(measured, F.col("exported")).otherwise(F.col("prod") - F.col("self_kwh"))).alias("to_grid_kwh"),
        kept(F.col("complete")).alias("complete"),
        kept(F.col("continuous")).alias("continuous"),
        F.coalesce("early", "incomplete").alias("notes"),
        written.alias("written"),
    )
