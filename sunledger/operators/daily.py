"""Daily energy per device with coverage and continuity verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sunledger import KEY
from sunledger.functions.timeutil import day_seconds, span_seconds
from sunledger.operators import counters as C

# Default thresholds and bucket of the quality flags.
INVERTER_COVERAGE_MIN = 0.90
METER_COVERAGE_MIN = 0.995
CONTINUITY_MIN = 0.90
BUCKET_SECONDS = 30

# Diagnostics of a device-day.
NO_SAMPLES = "no samples for day"
COUNTER_BAD = "counter unavailable or went backwards"
ZERO_PRODUCTION = "needs review: zero production"
LOW_COVERAGE = "needs review: coverage %d%% (%d/%d s)"


def daylight_join(days: DataFrame, daylight: DataFrame | None) -> DataFrame:
    """Attach the expected daylight seconds of each (site, day); NULL where unknown."""
    if daylight is None:
        return days.withColumn("daylight_s", F.lit(None).cast("int"))
    calendar = daylight.select("site_id", "day", F.col("seconds").alias("daylight_s"))
    return days.join(calendar, ["site_id", "day"], "left")


def _on_spine(spine: DataFrame, per_day: DataFrame) -> DataFrame:
    return spine.select(*KEY, "day").join(per_day, [*KEY, "day"], "left")


INVERTER_COUNTERS = ["ac_energy"]
METER_COUNTERS = ["energy_active_import", "energy_active_export"]


def inverter_daily(
    samples: DataFrame,
    spine: DataFrame,
    daylight: DataFrame | None,
    tz: str | Column,
    coverage_min: float = INVERTER_COVERAGE_MIN,
    continuity_min: float = CONTINUITY_MIN,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """One row per spine device-day: production, quality figures, flags, notes.

    Boundaries and the sample count use rows with a counter value, bucket
    presence uses all rows.  With daylight known (and not zero) it is the
    denominator and a shortfall is flagged; otherwise the day length is, and
    coverage raises no doubt.
    """
    buckets = C.day_buckets(samples, INVERTER_COUNTERS, tz, bucket_seconds)
    return inverter_days(buckets, spine, daylight, tz, coverage_min, continuity_min, bucket_seconds)


def inverter_days(buckets: DataFrame, spine: DataFrame, daylight: DataFrame | None, tz: str | Column,
                  coverage_min: float, continuity_min: float, bucket_seconds: int) -> DataFrame:
    """:func:`inverter_daily` from bucketed samples."""
    per_day = C.day_boundaries(buckets, INVERTER_COUNTERS)
    df = daylight_join(_on_spine(spine, per_day), daylight)
    lit_day = F.col("daylight_s") > 0
    full = day_seconds("day", tz)
    expected = F.when(lit_day, F.col("daylight_s")).otherwise(full)
    counted = F.coalesce("ac_energy_count", F.lit(0))
    df = df.withColumns({
        "sample_count": counted,
        "first_ts": F.col("ac_energy_first_time"),
        "last_ts": F.col("ac_energy_last_time"),
        "first_kwh": F.col("ac_energy_first"),
        "last_kwh": F.col("ac_energy_last"),
        "produced_kwh": C.counter_delta("ac_energy_first", "ac_energy_last"),
        "span_s": F.coalesce(span_seconds("ac_energy_first_time", "ac_energy_last_time"), F.lit(0)),
        "coverage": C.coverage("ac_energy_first_time", "ac_energy_last_time", expected),
        "continuity": C.continuity(F.when(counted > 0, F.col("observed")), bucket_seconds, expected),
        "judged": F.coalesce(lit_day, F.lit(False)),
    })
    low = F.col("judged") & (F.col("coverage") < coverage_min)
    return df.select(
        *KEY, "day", "produced_kwh", "coverage",
        F.coalesce((F.col("produced_kwh") > 0) & ~low, F.lit(False)).alias("complete"),
        "continuity",
        ((F.col("sample_count") > 0) & (~F.col("judged") | (F.col("continuity") >= continuity_min))).alias("continuous"),
        "sample_count", "first_ts", "last_ts", "first_kwh", "last_kwh",
        F.when(F.col("sample_count") == 0, NO_SAMPLES)
        .when(F.col("produced_kwh").isNull(), COUNTER_BAD)
        .when(F.col("produced_kwh") == 0, ZERO_PRODUCTION)
        .when(low, F.format_string(LOW_COVERAGE, F.rint(F.col("coverage") * 100.0).cast("long"), "span_s", "daylight_s"))
        .alias("notes"),
    )


def meter_daily(
    samples: DataFrame,
    spine: DataFrame,
    tz: str | Column,
    coverage_min: float = METER_COVERAGE_MIN,
    continuity_min: float = CONTINUITY_MIN,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """One row per spine device-day: import and export energy, flags, notes.

    Count, span and buckets use all rows; each counter skips its own NULLs.
    """
    buckets = C.day_buckets(samples, METER_COUNTERS, tz, bucket_seconds)
    return meter_days(buckets, spine, tz, coverage_min, continuity_min, bucket_seconds)


def meter_days(buckets: DataFrame, spine: DataFrame, tz: str | Column,
               coverage_min: float, continuity_min: float, bucket_seconds: int) -> DataFrame:
    """:func:`meter_daily` from bucketed samples."""
    imp, exp = METER_COUNTERS
    df = _on_spine(spine, C.day_boundaries(buckets, METER_COUNTERS))
    df = df.withColumn("full_secs", day_seconds("day", tz))
    df = df.withColumns({
        "sample_count": F.coalesce("rows", F.lit(0)),
        "imported_kwh": C.counter_delta(f"{imp}_first", f"{imp}_last"),
        "exported_kwh": C.counter_delta(f"{exp}_first", f"{exp}_last"),
        "span_s": F.coalesce(span_seconds("first_time", "last_time"), F.lit(0)),
        "coverage": C.coverage("first_time", "last_time", F.col("full_secs")),
        "continuity": C.continuity(F.col("observed"), bucket_seconds, F.col("full_secs")),
    })
    usable = F.col("imported_kwh").isNotNull() & F.col("exported_kwh").isNotNull()
    low = F.col("coverage") < coverage_min
    return df.select(
        *KEY, "day", "imported_kwh", "exported_kwh", "coverage",
        (usable & ~low).alias("complete"),
        "continuity",
        ((F.col("sample_count") > 0) & (F.col("continuity") >= continuity_min)).alias("continuous"),
        "sample_count", F.col("first_time").alias("first_ts"), F.col("last_time").alias("last_ts"),
        F.col(f"{imp}_first").alias("imported_kwh_first"), F.col(f"{imp}_last").alias("imported_kwh_last"),
        F.col(f"{exp}_first").alias("exported_kwh_first"), F.col(f"{exp}_last").alias("exported_kwh_last"),
        F.when(F.col("sample_count") == 0, NO_SAMPLES)
        .when(~usable, COUNTER_BAD)
        .when(low, F.format_string(LOW_COVERAGE, F.rint(F.col("coverage") * 100.0).cast("long"), "span_s", "full_secs"))
        .alias("notes"),
    )
