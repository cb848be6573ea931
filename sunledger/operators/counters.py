"""Counter boundaries, deltas and presence per local day.

All ordered aggregates are ``min_by``/``max_by`` over primitive columns, so the
whole day is one codegen'd hash aggregation with map-side combine: no sort, no
window, and a single device holding most of the rows is combined before the
shuffle.  Samples are unique per (device, time), so time alone orders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sunledger import KEY
from sunledger.functions.timeutil import local_day, span_seconds, time_bucket


def day_buckets(samples: DataFrame, counters: list[str], tz: str | Column, bucket_seconds: int,
                power: str | None = None) -> DataFrame:
    """First level: one row per (device, local day, bucket).

    Grouping by bucket first makes the later count of buckets a plain count
    instead of a distinct count, which would expand every row.  With a
    ``power`` column the same pass also prepares the downsampled power.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.min("time").alias("t0"), F.max("time").alias("t1")]
    if power is not None:
        aggs += [F.count(power).alias("power_n"), F.sum(power).alias("power_sum"),
                 F.min(power).alias("power_min"), F.max(power).alias("power_max")]
    for c in counters:
        at = F.when(F.col(c).isNotNull(), F.col("time"))
        aggs += [
            F.count(c).alias(f"{c}_n"),
            F.min(at).alias(f"{c}_t0"),
            F.max(at).alias(f"{c}_t1"),
            F.min_by(c, at).alias(f"{c}_v0"),
            F.max_by(c, at).alias(f"{c}_v1"),
        ]
    return (
        samples.select(*KEY, "time", *counters, *([power] if power else []),
                       local_day("time", tz).alias("day"),
                       time_bucket("time", bucket_seconds).alias("bucket"))
        .groupBy(*KEY, "day", "bucket")
        .agg(*aggs)
    )


def day_boundaries(buckets: DataFrame, counters: list[str]) -> DataFrame:
    """Second level: one row per (device, local day).

    ``rows``/``first_time``/``last_time`` cover all samples; ``<counter>_count``
    and its boundary columns only those with a counter value; ``observed`` is
    the number of distinct buckets with any sample.
    """
    aggs = [
        F.count(F.lit(1)).alias("observed"),
        F.sum("n").alias("rows"),
        F.min("t0").alias("first_time"),
        F.max("t1").alias("last_time"),
    ]
    for c in counters:
        aggs += [
            F.sum(f"{c}_n").alias(f"{c}_count"),
            F.min(f"{c}_t0").alias(f"{c}_first_time"),
            F.max(f"{c}_t1").alias(f"{c}_last_time"),
            F.min_by(f"{c}_v0", f"{c}_t0").alias(f"{c}_first"),
            F.max_by(f"{c}_v1", f"{c}_t1").alias(f"{c}_last"),
        ]
    return buckets.groupBy(*KEY, "day").agg(*aggs)


def counter_boundary(samples: DataFrame, counters: list[str], tz: str | Column, bucket_seconds: int = 30) -> DataFrame:
    """Value of each counter at its earliest and latest reading of the day."""
    return day_boundaries(day_buckets(samples, counters, tz, bucket_seconds), counters)


def counter_delta(first: Column | str, last: Column | str) -> Column:
    """Energy of the day; NULL when a boundary is missing or the counter went backwards."""
    first = F.col(first) if isinstance(first, str) else first
    last = F.col(last) if isinstance(last, str) else last
    return F.when(last >= first, last - first)


def bucket_presence(samples: DataFrame, tz: str | Column, bucket_seconds: int = 30) -> DataFrame:
    """Distinct buckets with samples per (device, local day)."""
    return (
        samples.select(*KEY, local_day("time", tz).alias("day"), time_bucket("time", bucket_seconds).alias("bucket"))
        .groupBy(*KEY, "day", "bucket").agg(F.lit(1).alias("seen"))
        .groupBy(*KEY, "day").agg(F.count(F.lit(1)).alias("observed"))
    )


def coverage(first_time: str, last_time: str, expected: Column) -> Column:
    """First-to-last span over the expected seconds, 0 without samples, not capped."""
    return F.coalesce(span_seconds(first_time, last_time) / expected, F.lit(0.0))


def continuity(observed: Column, bucket_seconds: int, expected: Column) -> Column:
    """Observed over expected buckets, 0 without samples, not capped."""
    return F.coalesce(observed * F.lit(float(bucket_seconds)) / expected, F.lit(0.0))
