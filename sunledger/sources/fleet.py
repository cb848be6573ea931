"""A dense, deterministic fleet for tests and scaling runs.

Every value is computed from the row's number: no files and any size.
Each site has ``inv0``, ``inv1`` (a reading per 4 s of daylight) and ``grid``,
``heatpump`` (a reading per 2 s).  Counters are whole Wh in closed form.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger import KEY
from sunledger.functions.solar import daylight_calendar
from sunledger.functions.timeutil import day_spine, day_start

TZ = "Europe/Berlin"
PEAK_W = 4000.0
HOUSE_W = 600.0
INVERTER_STEP = 4
METER_STEP = 2
# What happens at a site, by its number modulo the number of scenarios.
SCENARIOS = ["clean", "midday_gap", "missing_morning", "zero_day", "counter_reset", "empty_day"]


def site_numbers(spark: SparkSession, n_sites: int) -> DataFrame:
    return spark.range(n_sites).select(
        F.concat(F.lit("F"), "id").alias("site_id"),
        F.element_at(F.array(*map(F.lit, SCENARIOS)), (F.col("id") % len(SCENARIOS)).cast("int") + 1).alias("scenario"),
        (F.lit(40.0) + F.col("id") % 15).alias("latitude"), F.lit(9.15).alias("longitude"), F.lit(-0.833).alias("horizon_deg"))


def registry(spark: SparkSession, n_sites: int) -> DataFrame:
    """Even sites are metered at the feed-in point, odd ones in the consumption path."""
    name = F.col("device_name")
    even = F.substring("site_id", 2, 10).cast("long") % 2 == 0
    return site_numbers(spark, n_sites).select(
        "site_id", F.explode(F.array(*map(F.lit, ["inv0", "inv1", "grid", "heatpump"]))).alias("device_name")
    ).select(
        *KEY, F.when(name.startswith("inv"), "inverter").otherwise("meter").alias("kind"),
        F.when((name == "grid") & even, "feed-in").when(~name.startswith("inv"), "consumption").alias("location"),
        (name == "grid").alias("is_primary"))


def _slots(spark: SparkSession, n_sites: int, first: dt.date, days: int, step: int, devices: list[str]) -> DataFrame:
    per_day = 90000 // step  # room for the longest local day
    n = F.col("id")
    slot = n % per_day
    rest = F.floor(n / per_day)
    device = F.element_at(F.array(*map(F.lit, devices)), (rest % len(devices)).cast("int") + 1)
    rest = F.floor(rest / len(devices))
    number = F.floor(rest / days)
    return spark.range(n_sites * days * len(devices) * per_day).select(
        F.concat(F.lit("F"), number).alias("site_id"), device.alias("device_name"),
        F.date_add(F.lit(first), (rest % days).cast("int")).alias("local_day"),
        (slot * step).alias("second"), n.alias("seq"),
        F.element_at(F.array(*map(F.lit, SCENARIOS)), (number % len(SCENARIOS)).cast("int") + 1).alias("scenario"))


def _in_day(df: DataFrame) -> DataFrame:
    start = day_start("local_day", TZ)
    df = df.withColumns({"start_s": F.unix_seconds(start), "end_s": F.unix_seconds(day_start(F.date_add("local_day", 1), TZ))})
    df = df.where(F.col("start_s") + F.col("second") < F.col("end_s"))
    return df.withColumn("time", F.timestamp_seconds(F.col("start_s") + F.col("second"))).where("scenario <> 'empty_day'")


def inverter_samples(spark: SparkSession, n_sites: int, first: dt.date, days: int) -> DataFrame:
    df = _in_day(_slots(spark, n_sites, first, days, INVERTER_STEP, ["inv0", "inv1"]))
    places = day_spine(site_numbers(spark, n_sites), first, first + dt.timedelta(days=days - 1))
    calendar = daylight_calendar(places, TZ).select("site_id", F.col("day").alias("local_day"), "sunrise", "seconds")
    df = df.join(calendar, ["site_id", "local_day"]).withColumnRenamed("local_day", "day")
    passed = (F.unix_seconds("time") - F.unix_seconds("sunrise")) / F.col("seconds")
    df = df.withColumn("f", passed).where("f >= 0 AND f <= 1")
    df = df.where(~((F.col("scenario") == "midday_gap") & F.col("f").between(0.3, 0.6)))
    df = df.where(~((F.col("scenario") == "missing_morning") & (F.col("f") < 0.4)))
    idle = F.col("scenario") == "zero_day"
    power = F.when(idle, 0.0).otherwise(PEAK_W * F.sin(F.lit(math.pi) * F.col("f")))
    # Energy of the day so far on top of a base that grows by day.
    base = F.datediff("day", F.lit(first)) * F.lit(40000.0)
    wh = F.when(idle, base).otherwise(
        base + F.floor(PEAK_W * F.col("seconds") / 3600.0 * (1.0 - F.cos(F.lit(math.pi) * F.col("f"))) / math.pi))
    reset = (F.col("scenario") == "counter_reset") & (F.col("f") > 0.5)
    return df.select(
        *KEY, "time", "seq", F.when(reset, 0.0).otherwise(wh / 1000.0).alias("ac_energy"),
        power.cast("float").alias("ac_power_active"), F.to_date("time").alias("day"))


def meter_samples(spark: SparkSession, n_sites: int, first: dt.date, days: int) -> DataFrame:
    df = _in_day(_slots(spark, n_sites, first, days, METER_STEP, ["grid", "heatpump"]))
    df = df.where(~((F.col("scenario") == "midday_gap") & F.col("second").between(36000, 50000)))
    df = df.where(~((F.col("scenario") == "missing_morning") & (F.col("second") < 28800)))
    noise = F.pmod(F.xxhash64("site_id", F.floor(F.unix_seconds("time") / 60)), F.lit(200)) - 100
    wh = F.floor((F.unix_seconds("time") - F.unix_seconds(F.lit(first).cast("timestamp")) + 86400) * HOUSE_W / 3600.0)
    reset = (F.col("scenario") == "counter_reset") & (F.col("second") > 43200)
    return df.select(
        *KEY, "time", "seq", F.when(reset, 0.0).otherwise(wh / 1000.0).alias("energy_active_import"),
        F.floor(wh / 10) / 1000.0, F.lit(HOUSE_W) + noise,
        F.to_date("time").alias("day")).toDF(
        *KEY, "time", "seq", "energy_active_import", "energy_active_export", "power_active", "day").withColumn(
        "power_active", F.col("power_active").cast("float"))
