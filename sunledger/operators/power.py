"""Downsampled active power: average, minimum and maximum per bucket."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from sunledger import KEY
from sunledger.functions.timeutil import time_bucket

# Bucket widths of the two kept resolutions.
POWER_30SEC = 30
POWER_5MIN = 300
# Zone offsets are multiples of a quarter hour, so days begin on such a boundary.
OFFSET_STEP = 900


def power_column(kind: str) -> str:
    return "ac_power_active" if kind == "inverter" else "power_active"


def power_rows(samples: DataFrame, kind: str) -> DataFrame:
    """The (device, time, power) rows both resolutions are built from."""
    return samples.select(*KEY, F.lit(kind).alias("kind"), "time", F.col(power_column(kind)).alias("power"))


def downsample(rows: DataFrame, bucket_seconds: int) -> DataFrame:
    """avg/min/max power per (device, bucket); NULL power keeps its bucket."""
    return (
        rows.withColumn("bucket", time_bucket("time", bucket_seconds))
        .groupBy(*KEY, "kind", "bucket")
        .agg(
            F.avg("power").alias("avg_power"),
            F.min("power").alias("min_power"),
            F.max("power").alias("max_power"),
        )
    )


def power_from_buckets(buckets: DataFrame, kind: str, bucket_seconds: int, from_seconds: int | None = None) -> DataFrame:
    """Downsampled power from day buckets that carry sums and counts.

    Day buckets of the wanted width need no second aggregation, hence no
    shuffle, unless a day can begin inside a bucket.
    """
    rows = buckets.select(*KEY, F.lit(kind).alias("kind"), time_bucket("bucket", bucket_seconds).alias("bucket"),
                          "power_n", "power_sum", "power_min", "power_max")
    average = F.try_divide("power_sum", "power_n").alias("avg_power")
    if from_seconds == bucket_seconds and OFFSET_STEP % bucket_seconds == 0:
        return rows.select(*KEY, "kind", "bucket", average,
                           F.col("power_min").alias("min_power"), F.col("power_max").alias("max_power"))
    return rows.groupBy(*KEY, "kind", "bucket").agg(
        F.sum("power_sum").alias("power_sum"), F.sum("power_n").alias("power_n"),
        F.min("power_min").alias("min_power"), F.max("power_max").alias("max_power"),
    ).select(*KEY, "kind", "bucket", average, "min_power", "max_power")


def refresh_range(
    rows: DataFrame,
    bucket_seconds: int,
    now: dt.datetime | None = None,
    start_offset: dt.timedelta | None = None,
    end_offset: dt.timedelta | None = None,
) -> DataFrame:
    """Buckets lying wholly inside [now - start_offset, now - end_offset].

    ``None`` leaves that side open, so both ``None`` is a full backfill.  The
    bounds are widened or narrowed to bucket edges before the aggregation, as
    plain predicates on ``time``.
    """
    far = dt.timedelta(days=365 * 200)
    first, stop = bucket_range(bucket_seconds, now or dt.datetime(1970, 1, 1), start_offset or far, end_offset or -far)
    if start_offset is not None:
        rows = rows.where(F.col("time") >= F.lit(first).cast("timestamp"))
    if end_offset is not None:
        rows = rows.where(F.col("time") < F.lit(stop).cast("timestamp"))
    return downsample(rows, bucket_seconds)


def bucket_range(bucket_seconds: int, now: dt.datetime, start_offset: dt.timedelta,
                 end_offset: dt.timedelta) -> tuple[dt.datetime, dt.datetime]:
    """[first, stop): the whole buckets inside [now - start_offset, now - end_offset]."""
    step, epoch = dt.timedelta(seconds=bucket_seconds), dt.datetime(1970, 1, 1)
    return (epoch + -((epoch - (now - start_offset)) // step) * step, epoch + ((now - end_offset - epoch) // step) * step)
