"""Early ends of a site-day, both balances, roster handling."""

import datetime as dt

import pytest

from sunledger.operators import devices, site, validation

DAY = dt.date(2024, 1, 10)
AT = dt.datetime(2024, 1, 10, 12)
REGISTRY = "site_id string, device_name string, kind string, location string, is_primary boolean"
INVERTER = "site_id string, device_name string, day date, produced_kwh double, complete boolean, continuous boolean"
METER = "site_id string, device_name string, day date, imported_kwh double, exported_kwh double, complete boolean, continuous boolean"
POWER = "site_id string, device_name string, kind string, bucket timestamp, avg_power double"


def balance(spark, registry, inverters, meters, power, sites):
    days = spark.createDataFrame([(s, DAY) for s in sites], "site_id string, day date")
    df = site.site_energy(
        spark.createDataFrame(inverters, INVERTER), spark.createDataFrame(meters, METER),
        spark.createDataFrame(power, POWER), spark.createDataFrame(registry, REGISTRY), days, "UTC")
    return {r.site_id: r for r in df.collect()}


def test_every_outcome_of_a_site_day(spark):
    registry, inverters, meters, power = [], [], [], []

    def add(name, location, inv=True, primary=True, meter=(4.0, 3.0), with_power=True, flags=(True, True)):
        if inv:
            registry.append((name, "inv", "inverter", None, False))
            inverters.append((name, "inv", DAY, 10.0, *flags))
            if with_power:
                power.append((name, "inv", "inverter", AT, 5000.0))
        registry.append((name, "grid", "meter", location, primary))
        registry.append((name, "aux", "meter", "consumption", False))
        meters.append((name, "aux", DAY, 99.0, 99.0, False, False))  # never counted
        if meter:
            meters.append((name, "grid", DAY, *meter, True, True))
            if with_power:
                power.append((name, "grid", "meter", AT, 120000.0))

    add("measured", "feed-in")
    add("export_above", "feed-in", meter=(4.0, 11.0))
    add("measured_no_inverter", "feed-in", inv=False)
    add("simulated", "consumption")
    add("flagged", "consumption", flags=(False, None))
    add("no_primary", "feed-in", primary=False)
    add("no_location", None)
    add("grid_missing", "feed-in", meter=None)
    add("grid_null", "feed-in", meter=(4.0, None))
    add("consumption_missing", "consumption", meter=None)
    add("no_inverters", "consumption", inv=False)
    add("no_power", "consumption", with_power=False)
    names = {r[0] for r in registry}
    got = balance(spark, registry, inverters, meters, power, [*names, "unknown"])

    def figures(name):
        r = got[name]
        return [r.production_kwh, r.consumption_kwh, r.self_consumption_kwh, r.from_grid_kwh, r.to_grid_kwh]

    assert {n: r.notes for n, r in got.items() if not r.written} == {
        "no_primary": "no primary meter", "no_location": "no primary meter", "unknown": "no primary meter",
        "grid_missing": "grid meter row missing", "grid_null": "grid meter row missing",
        "consumption_missing": "consumption meter row missing", "no_inverters": "no inverters configured",
        "no_power": "no power data for day"}
    assert figures("measured") == [10.0, 11.0, 7.0, 4.0, 3.0]
    assert figures("export_above") == [10.0, 4.0, 0.0, 4.0, 11.0]
    assert figures("measured_no_inverter") == [0.0, 4.0, 0.0, 4.0, 3.0]
    overlap = 5000.0 * 30 / 3600 / 1000
    assert figures("simulated") == pytest.approx([10.0, 4.0, overlap, 4.0 - overlap, 10.0 - overlap])
    assert (got["simulated"].complete, got["simulated"].continuous, got["simulated"].notes) == (True, True, None)
    assert (got["flagged"].complete, got["flagged"].continuous, got["flagged"].notes) == (False, False, "incomplete: inv")


def test_overlap_is_clamped_and_negative_power_ignored(spark):
    registry = [("S", "a", "inverter", None, False), ("S", "b", "inverter", None, False), ("S", "grid", "meter", "consumption", True)]
    inverters = [("S", "a", DAY, 0.01, True, True), ("S", "b", DAY, None, True, True)]
    power = [("S", d, k, AT + dt.timedelta(seconds=30 * i), p) for d, k, i, p in (
        ("a", "inverter", 0, 9e6), ("b", "inverter", 0, -9e9), ("grid", "meter", 0, 9e6), ("grid", "meter", 1, -5.0), ("a", "inverter", 2, None))]
    r = balance(spark, registry, inverters, [("S", "grid", DAY, 5.0, None, True, True)], power, ["S"])["S"]
    assert (r.self_consumption_kwh, r.to_grid_kwh, r.from_grid_kwh) == (0.01, 0.0, 4.99)


def test_missing_rows_are_listed_in_order(spark):
    registry = [("S", n, "inverter", None, False) for n in ("z", "b", "a")] + [("S", "grid", "meter", "feed-in", True)]
    r = balance(spark, registry, [("S", "b", DAY, 1.0, True, True)], [("S", "grid", DAY, 1.0, 1.0, False, True)], [], ["S"])["S"]
    assert r.notes == "incomplete: a, z, grid" and not r.continuous


def test_removed_device_leaves_the_balance(spark):
    registry = [("S", "a", "inverter", None, False), ("S", "grid", "meter", "feed-in", True)]
    inverters = [("S", "a", DAY, 1.0, True, True), ("S", "gone", DAY, 5.0, False, False)]
    r = balance(spark, registry, inverters, [("S", "grid", DAY, 1.0, 1.0, True, True)], [], ["S"])["S"]
    assert r.production_kwh == 1.0 and r.complete


def test_roster_replacement(spark):
    old = spark.createDataFrame([("A", "x", "meter", None, False), ("A", "y", "meter", None, False), ("B", "x", "meter", None, False)], REGISTRY)
    new = spark.createDataFrame([("A", "y", "meter", "feed-in", True), ("A", "w", "inverter", None, False)], REGISTRY)
    assert {tuple(r) for r in devices.sync_registry(old, new).collect()} == {
        ("A", "y", "meter", "feed-in", True), ("A", "w", "inverter", None, False), ("B", "x", "meter", None, False)}
    assert [tuple(r)[:2] for r in devices.registry_anti(old, new).collect()] == [("A", "x")]


def test_site_replacement_defaults_the_horizon(spark):
    schema = "site_id string, latitude double, longitude double, horizon_deg double"
    old = spark.createDataFrame([("A", 1.0, 2.0, -3.0), ("B", 1.0, 2.0, -3.0)], schema)
    new = spark.createDataFrame([("A", None, None, None)], schema)
    assert {tuple(r) for r in devices.site_upsert(old, new).collect()} == {("A", None, None, -0.833), ("B", 1.0, 2.0, -3.0)}


def test_device_history(spark):
    schema = "site_id string, device_name string, serial_number string, model string, ts timestamp"
    seen = [("S", "d", "1", "old", dt.datetime(2024, 1, 1)), ("S", "d", "1", "new", dt.datetime(2024, 1, 3)),
            ("S", "d", "2", "swap", dt.datetime(2024, 1, 4))]
    first = devices.device_upsert(spark.createDataFrame(seen[:1], schema))
    rows = devices.device_upsert(spark.createDataFrame(seen[1:], schema), first).orderBy("serial_number").collect()
    assert [(r.serial_number, r.model, r.first_seen.day, r.last_seen.day) for r in rows] == [("1", "new", 1, 3), ("2", "swap", 4, 4)]


def test_null_checks_pass_like_sql(spark):
    df = spark.createDataFrame([(None, 3, None), (5, 4, "x"), (248, 1, "float")], "slave_id int, phases int, register_model string")
    got = [r.violations for r in validation.constraint_split(df, validation.rule_sets()["meter_device"]).collect()]
    assert got == [[], ["device_phases", "device_register"], ["device_slave_id"]]


def test_roster_rules(spark):
    rows = [("A", "ok-1_B", "meter", "feed-in", True), ("A", "twin", "meter", None, False), ("A", "twin", "inverter", None, False),
            ("B", "p1", "meter", "feed-in", True), ("B", "p2", "meter", None, True), ("B", "inverter", "meter", None, False),
            ("B", "", "meter", None, False), ("B", "a b", "meter", None, False), ("B", "n" * 33, "meter", None, False)]
    df = validation.registry_validate(spark.createDataFrame(rows, REGISTRY))
    got = sorted((r.site_id, r.device_name, tuple(r.violations)) for r in df.collect())
    assert got == sorted([
        ("A", "ok-1_B", ()), ("A", "twin", ("name_duplicate",)), ("A", "twin", ("name_duplicate",)),
        ("B", "p1", ("several_primaries",)), ("B", "p2", ("several_primaries", "primary_without_location")),
        ("B", "inverter", ("name_reserved",)), ("B", "", ("name_empty",)), ("B", "a b", ("name_form",)), ("B", "n" * 33, ("name_too_long",))])
    sites = spark.createDataFrame([(91.0, 0.0, -0.8), (None, None, -19.0)], "latitude double, longitude double, horizon_deg double")
    assert [r.violations for r in validation.rejected_rows(sites, validation.rule_sets()["site"]).collect()] == [["site_latitude"], ["site_horizon"]]
