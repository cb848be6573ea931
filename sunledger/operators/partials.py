"""Kept day buckets: what each batch of samples adds to its 30-second buckets, stored with the samples and merged when read.

Rows of one bucket from several batches merge to what ``day_buckets`` makes of all of their samples, so daily rollups and power
need no raw sample. A bucket is kept by its UTC day; zone offsets are multiples of the bucket width, so it lies in one local day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from sunledger import KEY
from sunledger.functions.timeutil import in_local_days, local_day
from sunledger.operators.counters import day_buckets
from sunledger.operators.daily import BUCKET_SECONDS, INVERTER_COUNTERS, METER_COUNTERS
from sunledger.operators.power import power_column
from sunledger.schemas import TABLES

COUNTERS = {"inverter": INVERTER_COUNTERS, "meter": METER_COUNTERS}
BUCKET_TABLES = {"inverter": "inverter_buckets", "meter": "meter_buckets"}


def partial_buckets(samples: DataFrame, kind: str) -> DataFrame:
    """Rows of the kind's bucket table for samples that are stored for the first time."""
    rows = day_buckets(samples, COUNTERS[kind], "UTC", BUCKET_SECONDS, power_column(kind))
    return rows.select(*TABLES[BUCKET_TABLES[kind]].fieldNames())


def merge_buckets(parts: DataFrame, kind: str) -> DataFrame:
    """One row per (device, day, bucket)."""
    aggs = [F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
            F.sum("power_n").alias("power_n"), F.sum("power_sum").alias("power_sum"),
            F.min("power_min").alias("power_min"), F.max("power_max").alias("power_max")]
    for c in COUNTERS[kind]:
        aggs += [F.sum(f"{c}_n").alias(f"{c}_n"), F.min(f"{c}_t0").alias(f"{c}_t0"), F.max(f"{c}_t1").alias(f"{c}_t1"),
                 F.min_by(f"{c}_v0", f"{c}_t0").alias(f"{c}_v0"), F.max_by(f"{c}_v1", f"{c}_t1").alias(f"{c}_v1")]
    return parts.groupBy(*KEY, "day", "bucket").agg(*aggs).select(*parts.columns)


def local_buckets(stored: DataFrame, kind: str, first: dt.date, last: dt.date, tz: str) -> DataFrame:
    """Day buckets of local days ``first`` .. ``last`` from a kept table; a zone is at most a day off UTC."""
    one = dt.timedelta(days=1)
    near = stored.where(F.col("day").between(F.lit(first - one), F.lit(last + one)))
    return merge_buckets(in_local_days(near, first, last, tz, "bucket").withColumn("day", local_day("bucket", tz)), kind)
