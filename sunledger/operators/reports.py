"""Reporting queries over the rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sunledger import KEY
from sunledger.functions.numeric import ratio
from sunledger.functions.timeutil import local_day
from sunledger.operators.ordered import latest


def site_ratios(site_energy: DataFrame) -> DataFrame:
    """Self-sufficiency and self-usage as fractions, NULL on a zero denominator."""
    return site_energy.select(
        "site_id", "day",
        ratio("self_consumption_kwh", "consumption_kwh").alias("self_sufficiency"),
        ratio("self_consumption_kwh", "production_kwh").alias("self_usage"),
        "complete", "continuous",
    )


def site_report(site_energy: DataFrame) -> DataFrame:
    return site_ratios(site_energy).orderBy("site_id", "day")


def completeness_stats(site_energy: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Days, their range, and how many are complete and continuous."""
    return site_energy.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("days"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count_if("complete").alias("complete_days"),
        F.count_if("continuous").alias("continuous_days"),
    )


def data_span(samples: DataFrame, tz: str | Column, by: list[str] | None = None) -> DataFrame:
    """First and last local day with samples, the range of a backfill."""
    return samples.groupBy(*(by or KEY)).agg(F.min("time").alias("t0"), F.max("time").alias("t1")).select(
        *(by or KEY), local_day("t0", tz).alias("first_day"), local_day("t1", tz).alias("last_day"))


def latest_sample(samples: DataFrame) -> DataFrame:
    """Newest sample per device."""
    return latest(samples, KEY, "time")


def latest_per_topic(messages: DataFrame) -> DataFrame:
    """The retained (last) message per topic."""
    return latest(messages, ["topic"], "seq")
