"""One device-day per diagnostic, and the dense fleet at the default limits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sunledger import KEY
from sunledger.functions.timeutil import day_spine
from sunledger.operators import daily
from sunledger.plans.rollup import compute_site_rollup
from sunledger.sources import fleet

DAY = dt.date(2024, 6, 10)
START = dt.datetime(2024, 6, 10)


def spine(spark, devices):
    return spark.createDataFrame([("S", d, DAY) for d in devices], "site_id string, device_name string, day date")


def inverter_rows(device, span_s, values, step=3600):
    """Values spread over ``span_s`` seconds from 04:00 UTC."""
    at = START + dt.timedelta(hours=4)
    gap = span_s / max(1, len(values) - 1)
    return [("S", device, at + dt.timedelta(seconds=i * gap), v) for i, v in enumerate(values)]


INVERTER = "site_id string, device_name string, time timestamp, ac_energy double"
METER = "site_id string, device_name string, time timestamp, energy_active_import double, energy_active_export double"


def sun(spark, seconds):
    return spark.createDataFrame([("S", DAY, seconds)], "site_id string, day date, seconds int")


def test_inverter_notes_and_flags(spark):
    rows = (
        inverter_rows("a_backwards", 36000, [5.0, 4.0]) + inverter_rows("b_zero", 36000, [5.0, 5.0])
        + inverter_rows("c_short", 18000, [5.0, 6.0]) + inverter_rows("d_clean", 36000, [5.0, 6.0])
        + inverter_rows("e_null_edge", 36000, [None, 5.0, 6.0, None]) + inverter_rows("f_all_null", 36000, [None, None]))
    names = ["a_backwards", "b_zero", "c_short", "d_clean", "e_null_edge", "f_all_null", "g_none"]
    df = daily.inverter_daily(spark.createDataFrame(rows, INVERTER), spine(spark, names), sun(spark, 36000), "UTC")
    got = {r.device_name: r for r in df.collect()}
    assert {n: r.notes for n, r in got.items()} == {
        "a_backwards": "counter unavailable or went backwards", "b_zero": "needs review: zero production",
        "c_short": "needs review: coverage 50% (18000/36000 s)", "d_clean": None,
        "e_null_edge": "needs review: coverage 33% (12000/36000 s)",
        "f_all_null": "no samples for day", "g_none": "no samples for day"}
    assert [n for n in names if got[n].complete] == ["d_clean"]
    edge = got["e_null_edge"]
    assert (edge.sample_count, edge.first_kwh, edge.last_kwh, edge.produced_kwh) == (2, 5.0, 6.0, 1.0)
    assert edge.continuity == 4 * 30 / 36000  # buckets of all rows, also those without a counter
    for name in ("f_all_null", "g_none"):
        r = got[name]
        assert (r.sample_count, r.coverage, r.continuity, r.complete, r.continuous, r.produced_kwh) == (0, 0.0, 0.0, False, False, None)


@pytest.mark.parametrize("seconds", [None, 0])
def test_without_daylight_coverage_raises_no_doubt(spark, seconds):
    rows = spark.createDataFrame(inverter_rows("inv", 3600, [1.0, 2.0]), INVERTER)
    r = daily.inverter_daily(rows, spine(spark, ["inv"]), None if seconds is None else sun(spark, 0), "UTC").first()
    assert (r.complete, r.continuous, r.notes, r.coverage) == (True, True, None, 3600 / 86400)


def test_uncapped_coverage(spark):
    rows = spark.createDataFrame(inverter_rows("inv", 40000, [1.0, 2.0]), INVERTER)
    assert daily.inverter_daily(rows, spine(spark, ["inv"]), sun(spark, 36000), "UTC").first().coverage > 1


def test_meter_notes_and_flags(spark):
    def rows(device, span_s, imports, exports):
        gap = span_s / max(1, len(imports) - 1)
        return [("S", device, START + dt.timedelta(seconds=i * gap), a, b) for i, (a, b) in enumerate(zip(imports, exports))]

    data = (rows("a_backwards", 86390, [2.0, 1.0], [1.0, 2.0]) + rows("b_no_export", 86390, [1.0, 2.0], [None, None])
            + rows("c_short", 43200, [1.0, 2.0], [1.0, 1.5]) + rows("d_clean", 86390, [1.0, 2.5], [1.0, 1.0]))
    names = ["a_backwards", "b_no_export", "c_short", "d_clean", "e_none"]
    df = daily.meter_daily(spark.createDataFrame(data, METER), spine(spark, names), "UTC")
    got = {r.device_name: r for r in df.collect()}
    bad = "counter unavailable or went backwards"
    assert {n: r.notes for n, r in got.items()} == {
        "a_backwards": bad, "b_no_export": bad, "c_short": "needs review: coverage 50% (43200/86400 s)",
        "d_clean": None, "e_none": "no samples for day"}
    assert [n for n in names if got[n].complete] == ["d_clean"]
    assert (got["d_clean"].imported_kwh, got["d_clean"].exported_kwh) == (1.5, 0.0)
    assert (got["b_no_export"].imported_kwh, got["b_no_export"].exported_kwh) == (1.0, None)


def test_coverage_percent_rounds_half_to_even(spark):
    rows = spark.createDataFrame(inverter_rows("inv", 20200, [1.0, 2.0]), INVERTER)
    # 20200 / 80000 is 25.25 %, 19600 / 80000 is 24.5 % and goes to the even 24.
    assert "25%" in daily.inverter_daily(rows, spine(spark, ["inv"]), sun(spark, 80000), "UTC").first().notes
    rows = spark.createDataFrame(inverter_rows("inv", 19600, [1.0, 2.0]), INVERTER)
    assert "24%" in daily.inverter_daily(rows, spine(spark, ["inv"]), sun(spark, 80000), "UTC").first().notes


@pytest.fixture(scope="module")
def fleet_result(spark):
    n, first = len(fleet.SCENARIOS) * 2, DAY
    roster = fleet.registry(spark, n)
    result = compute_site_rollup(
        fleet.inverter_samples(spark, n, first, 1), fleet.meter_samples(spark, n, first, 1), roster,
        fleet.site_numbers(spark, n), day_spine(roster.select(*KEY, "kind"), first, first), fleet.TZ)
    return {name: {tuple(r[k] for k in (KEY if name != "site_energy" else ["site_id"])): r for r in result[name].collect()}
            for name in ("inverter_daily", "meter_daily", "site_energy")}


def test_fleet_flags_at_default_limits(fleet_result):
    inverter = {s: fleet_result["inverter_daily"][f"F{i}", "inv0"] for i, s in enumerate(fleet.SCENARIOS)}
    assert {s: (r.complete, r.continuous) for s, r in inverter.items()} == {
        "clean": (True, True), "midday_gap": (True, False), "missing_morning": (False, False),
        "zero_day": (False, True), "counter_reset": (False, True), "empty_day": (False, False)}
    meter = {s: fleet_result["meter_daily"][f"F{i}", "grid"] for i, s in enumerate(fleet.SCENARIOS)}
    assert {s: (r.complete, r.continuous) for s, r in meter.items()} == {
        "clean": (True, True), "midday_gap": (True, False), "missing_morning": (False, False),
        "zero_day": (True, True), "counter_reset": (False, True), "empty_day": (False, False)}


def test_fleet_balances(fleet_result):
    rows = fleet_result["site_energy"].values()
    written = [r for r in rows if r.written]
    assert len(written) == 8 and len(rows) == 12
    for r in written:
        number = int(r.site_id[1:])
        assert r.self_consumption_kwh >= 0
        assert r.consumption_kwh == pytest.approx(r.self_consumption_kwh + r.from_grid_kwh)
        if number % 2 == 1:  # metered in the consumption path
            assert r.production_kwh == pytest.approx(r.self_consumption_kwh + r.to_grid_kwh)
            assert r.self_consumption_kwh <= min(r.production_kwh, r.consumption_kwh)
    clean = fleet_result["site_energy"][("F0",)]
    assert (clean.complete, clean.continuous, clean.notes) == (True, True, None)
    # 600 W of house load under two 4 kW inverters: nearly all of the daylight hours' load.
    twin = fleet_result["site_energy"][("F7",)]
    assert twin.notes is None and not twin.continuous and twin.self_consumption_kwh > 3
    assert {r.notes for r in rows if not r.written} == {"grid meter row missing", "consumption meter row missing"}


def test_power_from_day_buckets_equals_power_from_samples(spark):
    from sunledger.operators.counters import day_buckets
    from sunledger.operators.power import downsample, power_from_buckets, power_rows

    samples = fleet.meter_samples(spark, 1, DAY, 1).where("second(time) < 20 AND hour(time) < 3")
    samples = samples.withColumn("power_active", F.when(F.second("time") != 4, F.col("power_active")))
    # A zone whose days begin inside an hour bucket.
    for tz, width, step in (("Asia/Kolkata", 30, 30), ("Asia/Kolkata", 30, 300), ("Asia/Kolkata", 3600, 3600)):
        got = power_from_buckets(day_buckets(samples, [], tz, width, "power_active"), "meter", step, width)
        want = downsample(power_rows(samples, "meter"), step)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
        if step == 30:
            assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
