"""Rollups that follow the incoming samples."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sunledger.functions.timeutil import local_day
from sunledger.plans.rollup import run_site_rollup


def refresh_day(spark: SparkSession, store: str, now: dt.datetime, tz: str, days_back: int = 0) -> dt.date:
    """Recompute one local day: today (``days_back=0``, every few minutes) or, just after
    midnight, finalize yesterday (``days_back=1``).  ``now`` is an aware instant."""
    day = now.astimezone(ZoneInfo(tz)).date() - dt.timedelta(days=days_back)
    run_site_rollup(spark, store, day, day, tz)
    return day


def runs(days: list[dt.date]) -> list[tuple[dt.date, dt.date]]:
    """Ranges of consecutive days of a sorted list."""
    out: list[tuple[dt.date, dt.date]] = []
    for day in days:
        if out and day - out[-1][1] == dt.timedelta(days=1):
            out[-1] = (out[-1][0], day)
        else:
            out.append((day, day))
    return out


def start_live_rollup(samples: DataFrame, store: str, tz: str, checkpoint: str, available_now: bool = False,
                      every: str = "5 minutes") -> StreamingQuery:
    """Recompute the local days of the sites that each batch of stored samples touches.

    ``samples`` needs site_id and time: the union of the sample tables of both kinds, so that a day on which only meters
    reported is followed as well.
    """

    def recompute(batch: DataFrame, _: int) -> None:
        touched = batch.select("site_id", local_day("time", tz).alias("day")).distinct().persist()
        try:
            # One row per touched day; a few late samples do not drag in the days between.
            rows = touched.select("day").distinct().orderBy("day").collect()
            for first, last in runs([r["day"] for r in rows]):
                run_site_rollup(batch.sparkSession, store, first, last, tz, touched)
        finally:
            touched.unpersist()

    writer = samples.writeStream.foreachBatch(recompute).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()
