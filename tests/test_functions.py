"""Numeric rules, calendar time and daylight against known values."""

import datetime as dt
import math
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from sunledger.functions import electrical, numeric as N, solar, timeutil as TU

UTC = dt.timezone.utc


def half_away(x: float, places: int) -> float:
    scaled = Decimal(x * 10 ** places).quantize(Decimal(1), ROUND_HALF_UP)
    return float(scaled) / 10 ** places


def test_quantise_rounds_the_scaled_double_half_away_from_zero(spark):
    values = [0.5, 1.5, 2.5, -0.5, -2.5, 1.005, -1.005, 0.125, 2.675, 167301.4999, 1e15 + 0.5, 0.49999999999999994, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for quantity, places in N.DECIMALS.items():
        got = [r[0] for r in df.select(N.quantise("x", quantity)).collect()]
        assert got == [half_away(v, places) for v in values], quantity


def test_quantise_keeps_nan_infinity_and_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    got = [r[0] for r in df.select(N.quantise("x", "power")).collect()]
    assert math.isnan(got[0]) and got[1:] == [float("inf"), float("-inf"), None]


def test_scale_divides(spark):
    assert spark.range(1).select(N.scale_to_kilo(F.lit(167301.0))).first()[0] == 167.301


def test_derivations(spark):
    row = spark.range(1).select(
        N.efficiency(F.lit(80.0), F.lit(100.0)).alias("eff"), N.efficiency(F.lit(80.0), F.lit(1e-13)).alias("no_dc"),
        N.reactive_energy(F.lit(5.0), F.lit(3.0), F.lit(-1.0)).alias("lead"),
        N.reactive_energy(F.lit(5.0), F.lit(3.0), F.lit(0.0)).alias("zero_q"),
        N.reactive_energy(F.lit(3.0), F.lit(5.0), F.lit(1.0)).alias("nan"),
        N.apparent_energy(F.lit(3.0), F.lit(4.0)).alias("s"),
        N.current_total(F.array(F.lit(1.0), F.lit(2.0)), F.lit(9.0), F.lit("proprietary")).alias("summed"),
        N.current_total(F.array(F.lit(1.0), F.lit(2.0)), F.lit(9.0), F.lit("sunspec")).alias("measured"),
        N.ratio(F.lit(1.0), F.lit(0.0)).alias("no_whole"), N.positive_or_null(F.lit(0)).alias("no_id"),
        N.text_or_null(F.lit("")).alias("no_text"),
    ).first()
    assert (row.eff, row.no_dc, row.lead, row.zero_q, row.s) == (80.0, 0.0, -4.0, 4.0, 5.0)
    assert math.isnan(row.nan)
    assert (row.summed, row.measured, row.no_whole, row.no_id, row.no_text) == (3.0, 9.0, None, None, None)


@pytest.mark.parametrize("leading", [False, True])
def test_grid_assumption(spark, leading):
    df = spark.createDataFrame([(1000.0, 300.0, [100.0, 100.0, 100.0], [230.0, 231.0, 0.0])],
                               "energy double, power double, phase_power array<double>, phase_voltage array<double>")
    row = electrical.grid_assumption_derive(df, electrical.Grid(0.98, 50.0, leading)).first()
    phi = math.acos(0.98)
    assert row.power_apparent == pytest.approx(300 / 0.98)
    assert row.power_reactive == pytest.approx((-1 if leading else 1) * math.tan(phi) * 300)
    used, unused = ("export", "import") if leading else ("import", "export")
    assert row[f"energy_reactive_{used}"] == pytest.approx(math.sin(phi) * 1000 / 0.98)
    assert row[f"energy_reactive_{unused}"] == 0.0 and row[f"energy_apparent_{unused}"] == 0.0
    assert row.energy_active_import == 1000.0 and row.energy_active_export == 0.0
    assert row.phases[0].current == pytest.approx(100 / (230 * 0.98))
    assert row.phases[0].voltage_pp == pytest.approx(math.sqrt(230 ** 2 + 231 ** 2 + 230 * 231))
    assert row.phases[2].current is None and row.current is None


def days(spark, *values):
    return spark.createDataFrame([(dt.date.fromisoformat(v),) for v in values], "day date")


def test_day_lengths_across_clock_changes(spark):
    df = days(spark, "2024-03-30", "2024-03-31", "2024-10-27")
    got = [r.full_secs for r in TU.day_bounds(df, "Europe/Berlin").orderBy("day").collect()]
    assert got == [86400, 82800, 90000]


def test_repeated_civil_time_means_standard_time(spark):
    df = spark.sql("SELECT timestamp'2024-10-27 02:30:00' AS c")
    assert df.select(F.unix_seconds(TU.to_instant(F.col("c"), "Europe/Berlin"))).first()[0] == int(
        dt.datetime(2024, 10, 27, 1, 30, tzinfo=UTC).timestamp())


def test_day_starts_at_the_second_of_two_midnights(spark):
    # Havana sets clocks back at 01:00, so 2024-11-03 00:00 occurs twice.
    tz = "America/Havana"
    start = int(dt.datetime(2024, 11, 3, 5, 0, tzinfo=UTC).timestamp())
    assert days(spark, "2024-11-03").select(F.unix_seconds(TU.day_start("day", tz))).first()[0] == start
    times = spark.createDataFrame([(start - 1,), (start,)], "s long").select(F.timestamp_seconds("s").alias("time"))
    got = [r[0].isoformat() for r in times.select(TU.local_day("time", tz)).collect()]
    assert got == ["2024-11-02", "2024-11-03"]


def test_local_days_lie_within_their_bounds(spark):
    hours = spark.range(0, 24 * 400).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("time"))
    for tz in ("Europe/Berlin", "America/Havana", "Asia/Kolkata", "Australia/Lord_Howe", "America/Santiago"):
        df = TU.day_bounds(hours.withColumn("day", TU.local_day("time", tz)), tz)
        assert df.where("time < day_start OR time >= day_end").count() == 0, tz


def test_buckets_and_span(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:59.9' AS a, timestamp'2024-01-01 00:01:01.4' AS b")
    row = df.select(TU.time_bucket("a", 30).alias("x"), TU.span_seconds("a", "b").alias("s")).first()
    assert row.x == dt.datetime(2024, 1, 1, 0, 0, 30) and row.s == 2


def test_in_local_days_is_half_open(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 30, 23, 0),), (dt.datetime(2024, 3, 31, 21, 59, 59),),
                                (dt.datetime(2024, 3, 31, 22, 0),)], "time timestamp")
    day = dt.date(2024, 3, 31)
    assert TU.in_local_days(df, day, day, "Europe/Berlin").count() == 2


def calendar(spark, lat, lon, tz, *values, horizon=-0.833):
    df = days(spark, *values).withColumns({
        "site_id": F.lit("S"), "latitude": F.lit(lat), "longitude": F.lit(lon), "horizon_deg": F.lit(horizon)})
    return solar.daylight_calendar(df, tz).orderBy("day").collect()


def test_daylight_known_days(spark):
    rows = calendar(spark, 49.07, 9.15, "Europe/Berlin", "2026-06-21", "2026-12-21")
    assert [r.seconds for r in rows] == [58382, 29555]
    midnight = [dt.datetime(2026, 6, 20, 22), dt.datetime(2026, 12, 20, 23)]
    assert [(r.sunrise - m).total_seconds() for r, m in zip(rows, midnight)] == [19103, 29765]
    assert all(r.sunset - r.sunrise == r.daylight == dt.timedelta(seconds=r.seconds) for r in rows)


def test_polar_day_night_and_unknown_place(spark):
    summer, winter = calendar(spark, 80.0, 0.0, "UTC", "2024-06-21", "2024-12-21")
    assert (summer.seconds, summer.sunrise, summer.sunset) == (86400, None, None)
    assert (winter.seconds, winter.sunrise, winter.sunset) == (0, None, None)
    (nowhere,) = calendar(spark, None, None, "UTC", "2024-06-21")
    assert nowhere.seconds is None and nowhere.sunrise is None


def test_lower_horizon_lengthens_the_day(spark):
    (low,) = calendar(spark, 49.0, 9.0, "UTC", "2024-05-01", horizon=-3.0)
    (usual,) = calendar(spark, 49.0, 9.0, "UTC", "2024-05-01")
    assert low.seconds > usual.seconds
