"""Continuously maintained power buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from sunledger import KEY
from sunledger.operators.power import POWER_30SEC, POWER_5MIN
from sunledger.sources.store import upsert_days


@dataclass(frozen=True)
class Resolution:
    """Bucket width, how late a sample may come, and how often results are refreshed."""

    table: str
    seconds: int
    late: str
    every: str


# The two kept resolutions.
THIRTY_SECONDS = Resolution("power_30sec", POWER_30SEC, "1 hour", "1 minute")
FIVE_MINUTES = Resolution("power_5min", POWER_5MIN, "2 hours", "5 minutes")


def power_stream(rows: DataFrame, resolution: Resolution) -> DataFrame:
    """Windowed avg/min/max with state dropped once a window is past the lateness."""
    return (
        rows.withWatermark("time", resolution.late)
        .groupBy("site_id", "device_name", "kind", F.window("time", f"{resolution.seconds} seconds"))
        .agg(F.avg("power").alias("avg_power"), F.min("power").alias("min_power"), F.max("power").alias("max_power"))
        .select(*KEY, "kind", F.col("window.start").alias("bucket"), "avg_power", "min_power", "max_power")
    )


def start_power(rows: DataFrame, resolution: Resolution, path: str, checkpoint: str,
                available_now: bool = False) -> StreamingQuery:
    """Keep ``path`` up to date.  Update mode repeats a bucket as it grows, so the sink replaces by key."""

    def merge(batch: DataFrame, _: int) -> None:
        upsert_days(batch.sparkSession, batch.withColumn("day", F.to_date("bucket")), path, [*KEY, "bucket"])

    writer = (power_stream(rows, resolution).writeStream.outputMode("update")
              .foreachBatch(merge).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=resolution.every)
    return writer.start()
