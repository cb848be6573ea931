"""Messages, telegrams, fan-out."""

import datetime as dt
import json

import pytest

from sunledger.functions.electrical import Grid, grid_assumption_derive
from sunledger.operators import fanout
from sunledger.sources import messages as M, telegrams as TG

AT = dt.datetime(2025, 11, 8, 13, 18, 7, 640000)
READING = (
    "site_id string, device_name string, time timestamp, seq long, ac_energy double, ac_power_active double, "
    "ac_power_apparent double, ac_power_reactive double, ac_power_factor double, ac_frequency double, dc_power double, "
    "phases array<struct<ac_voltage:double,ac_current:double>>, "
    "inputs array<struct<dc_voltage:double,dc_current:double,dc_power:double,dc_energy:double>>, "
    "phase_count int, input_count int, hybrid boolean")


def reading(phases=1, inputs=2, hybrid=False, dc_power=285.2):
    return ("S", "roof", AT, 1, 11060234.4, 238.004, 238.126, 5.0, -100.0, 50.0, dc_power,
            [(235.94, 1.0004), (1.0, 1.0), (2.0, 2.0)], [(294.2, 0.45, 132.4, 5468412.0), (293.9, 0.52, 152.8, 123.0)],
            phases, inputs, hybrid)


@pytest.fixture(scope="module")
def quantised(spark):
    rows = [reading(), reading(phases=0, inputs=9, hybrid=True, dc_power=0.0)]
    return fanout.quantise_inverter(spark.createDataFrame(rows, READING))


def test_message_fields_in_order_and_round_trip(spark, quantised):
    msg = M.to_messages(quantised, "inverter", "plant/north")
    plain, hybrid = msg.collect()
    assert plain.topic == "plant/north/S/inverter/roof/values"
    body = json.loads(plain.payload)
    assert list(body) == ["time", "ac_energy", "ac_power_active", "ac_power_apparent", "ac_power_reactive", "ac_power_factor",
                          "phases", "ac_frequency", "dc_power", "efficiency", "inputs"]
    assert (body["time"], body["ac_energy"], body["ac_power_apparent"]) == (1762607887640, 11060.234, 238.13)
    assert body["efficiency"] == 83.45
    assert body["phases"] == [{"id": 1, "ac_voltage": 235.9, "ac_current": 1.0}]
    assert body["inputs"][0] == {"id": 1, "dc_voltage": 294.2, "dc_current": 0.45, "dc_power": 132.4, "dc_energy": 5468.412}
    other = json.loads(hybrid.payload)
    assert "dc_energy" not in hybrid.payload and len(other["phases"]) == 1 and len(other["inputs"]) == 2
    assert other["efficiency"] == 0.0
    back = M.parse_messages(msg, "inverter").collect()
    assert (back[0].site_id, back[0].device_name, back[0].time, back[0].malformed) == ("S", "roof", AT, False)
    assert back[0].inputs[1].dc_energy == 0.123 and back[1].inputs[1].dc_energy is None


def test_other_topics_and_broken_payloads(spark):
    rows = [("a/b/S/meter/m1/values", '{"time": 1, "power_active": 2.5, "phases": [{"id": 1, "current": 1.5}]}', 1),
            ("a/b/S/meter/m1/values", '{"time": ', 2), ("a/b/S/meter/m1/availability", "connected", 3),
            ("a/b/S/inverter/i/events", '{"active_code": 3, "state": "s", "events": ["e1"]}', 4),
            ("a/b/S/meter/m1/device", '{"serial_number": "1", "phases": 3}', 5), ("x", "y", 6)]
    df = spark.createDataFrame(rows, "topic string, payload string, seq long")
    got = {r.seq: r for r in M.parse_messages(df, "meter").collect()}
    assert set(got) == {1, 2} and got[2].malformed and got[2].time is None
    assert (got[1].power_active, got[1].current, got[1].phases[0].current) == (2.5, None, 1.5)
    assert [(r.state, r.seq) for r in M.parse_availability(df, "meter").collect()] == [("connected", 3)]
    assert M.parse_messages(df, "inverter", "events").first().events == ["e1"]
    device = M.parse_messages(df, "meter", "device").first()
    assert (device.serial_number, device.phases, device.slave_id) == ("1", 3, None)


def test_event_and_device_messages(spark):
    events = spark.createDataFrame([("S", "i", 1, "ok", [], 1)],
                                   "site_id string, device_name string, active_code int, state string, events array<string>, seq long")
    assert json.loads(M.event_messages(events).first().payload) == {"active_code": 1, "state": "ok", "events": []}
    device = spark.createDataFrame([("S", "m", "maker", "77", 2, 1)],
                                   "site_id string, device_name string, manufacturer string, serial_number string, phases int, seq long")
    row = M.device_messages(device, "meter").first()
    assert row.topic == "fleet/S/meter/m/device"
    assert json.loads(row.payload) == {"manufacturer": "maker", "serial_number": "77", "phases": 2}


def test_fan_out(spark, quantised):
    sample = fanout.inverter_rows(quantised).first()
    assert sample.ac_energy == 11060.234 and sample.ac_power_apparent == pytest.approx(238.13, abs=1e-5)
    assert dict(fanout.inverter_rows(quantised).dtypes)["ac_power_active"] == "float"
    phases = fanout.explode_phases(quantised, "inverter").collect()
    assert [r.phase_id for r in phases] == [1, 1]  # counts are kept within 1 and 3
    inputs = fanout.explode_inputs(quantised).collect()
    assert [(r.input_id, r.dc_energy) for r in inputs] == [(1, 5468.412), (2, 0.123), (1, None), (2, None)]


def telegram(*lines, end="!\r\n"):
    return "".join(line + "\r\n" for line in lines) + end


GOOD = ["/MTR5DD3_107", "", "1-0:96.1.0*255(1MTR77)", "1-0:1.8.0*255(00012345.67891*kWh)", "1-0:16.7.0*255(-450.25*W)",
        "1-0:36.7.0*255(100.00*W)", "1-0:56.7.0*255(150.00*W)", "1-0:76.7.0*255(200.25*W)", "1-0:32.7.0*255(230.1*V)",
        "1-0:52.7.0*255(231.2*V)", "1-0:72.7.0*255(232.3*V)", "1-0:0.2.0*255(whatever)"]


def parse(spark, *texts):
    df = spark.createDataFrame([("S", "grid", i, t) for i, t in enumerate(texts)],
                               "site_id string, device_name string, seq long, telegram string")
    return TG.parse_telegrams(df).orderBy("seq").collect()


def test_good_telegram(spark):
    (r,) = parse(spark, telegram(*GOOD))
    assert r.reject_reason is None
    assert (r.firmware_version, r.serial_number, r.power) == ("107", "1MTR77", -450.25)
    assert r.energy == 12345.67891 * 1000.0
    assert (r.phase_power, r.phase_voltage) == ([100.0, 150.0, 200.25], [230.1, 231.2, 232.3])


def test_rejects_name_their_reason(spark):
    cases = {
        TG.INCOMPLETE: telegram(*GOOD, end="\r\n"),
        TG.BAD_VERSION: telegram("/no version", *GOOD[1:]), TG.BAD_LINE: telegram(*GOOD, "1-0:1.8.0*255"),
        TG.BAD_NUMBER: telegram(*GOOD[:4], "1-0:16.7.0*255(none*W)")}
    assert [r.reject_reason for r in parse(spark, *cases.values())] == list(cases)


def test_long_telegrams_are_read_unless_a_bound_is_asked_for(spark):
    long = telegram(*GOOD, "1-0:0.2.1*255(" + "x" * 200 + ")")
    rows = spark.createDataFrame([(long,)], "telegram string")
    assert TG.parse_telegrams(rows).first().reject_reason is None
    assert TG.parse_telegrams(rows, max_bytes=368).first().reject_reason == TG.TOO_LONG


def test_missing_repeated_and_odd_lines(spark):
    missing, repeated, empty_value, no_version = parse(
        spark, telegram("/M_1", "", "1-0:36.7.0*255(7*W)"),
        telegram("/M_1", "/M_2", "1-0:16.7.0*255(1*W)", "1-0:16.7.0*255( +2.5e1x*W)", "!note"),
        telegram("/M_1", "1-0:16.7.0*255()"), telegram("1-0:16.7.0*255(3)"))
    assert (missing.reject_reason, missing.energy, missing.power, missing.phase_power) == (None, 0.0, 0.0, [7.0, 0.0, 0.0])
    assert (repeated.power, repeated.firmware_version) == (25.0, "2")  # the last line of a code counts
    assert empty_value.reject_reason == TG.BAD_LINE
    assert (no_version.reject_reason, no_version.power, no_version.firmware_version) == (None, 3.0, "")


def test_telegram_to_meter_rows(spark):
    df = spark.createDataFrame([("S", "grid", 5, AT, telegram(*GOOD))],
                               "site_id string, device_name string, seq long, received_at timestamp, telegram string")
    readings = TG.telegram_readings(TG.parse_telegrams(df)).withColumnRenamed("received_at", "time")
    full = fanout.quantise_meter(grid_assumption_derive(readings, Grid(0.98, 50.0, False)))
    row = fanout.meter_rows(full).first()
    assert (row.energy_active_import, row.energy_active_export) == (12345.679, 0.0)
    assert row.power_apparent == pytest.approx(round(450.25 / 0.98, 2), abs=1e-4) and row.voltage_ph == pytest.approx(231.2, abs=1e-4)
    assert fanout.explode_phases(full, "meter", count=None).count() == 3
    device = TG.telegram_devices(readings).first()
    assert (device.model, device.phases) == (TG.MODEL, 3)
