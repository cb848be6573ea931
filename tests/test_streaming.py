"""Streams equal batches; late rows, retries and state across batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sunledger import KEY
from sunledger.operators.power import downsample
from sunledger.session import work_dir
from sunledger.sources import tables as T
from sunledger.streaming import device_state as SD, ingest as SI, live as SL, power as SP

ROWS = "site_id string, device_name string, kind string, time timestamp, power float"
AT = dt.datetime(2024, 1, 1, 12)


def write_batches(spark, batches, schema, path):
    """One file per batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def power_row(minutes, power, device="inv"):
    return ("S", device, "inverter", AT + dt.timedelta(minutes=minutes), float(power))


def run_power(spark, batches, resolution):
    base = work_dir(spark, "stream")
    for rows in batches:  # each run is one micro-batch on the same checkpoint
        write_batches(spark, [rows], ROWS, f"{base}/in")
        stream = spark.readStream.schema(ROWS).parquet(f"{base}/in")
        SP.start_power(stream, resolution, f"{base}/out", f"{base}/cp", available_now=True).awaitTermination()
    return {(r.device_name, r.bucket): (r.avg_power, r.min_power, r.max_power)
            for r in spark.read.schema(T.TABLES["power_30sec"]).parquet(f"{base}/out").collect()}


def test_power_stream_equals_batch_and_drops_late_rows(spark):
    first = [power_row(0, 10), power_row(0.2, 30), power_row(1, 5, "inv2")]
    second = [power_row(0.1, 20), power_row(200, 1)]  # late by 12 s: counted
    third = [power_row(0.3, 999), power_row(201, 2)]  # over three hours late: dropped
    got = run_power(spark, [first, second, third], SP.THIRTY_SECONDS)
    kept = spark.createDataFrame([*first, *second, third[1]], ROWS)
    want = {(r.device_name, r.bucket): (r.avg_power, r.min_power, r.max_power) for r in downsample(kept, 30).collect()}
    assert got == want and got["inv", AT] == (20.0, 10.0, 30.0)


def test_fixed_limits():
    assert (SP.THIRTY_SECONDS.late, SP.THIRTY_SECONDS.every) == ("1 hour", "1 minute")
    assert (SP.FIVE_MINUTES.late, SP.FIVE_MINUTES.every, SP.FIVE_MINUTES.seconds) == ("2 hours", "5 minutes", 300)


def message(device, ms, seq, energy, phases=2, broken=False):
    items = ",".join(f'{{"id":{i},"ac_voltage":{230 + i},"ac_current":1.0}}' for i in range(1, phases + 1))
    body = f'{{"time":{ms},"ac_energy":{energy},"ac_power_active":1.5,"phases":[{items}],"inputs":[{{"id":1,"dc_power":2.0}}]}}'
    return (f"fleet/S/inverter/{device}/values", body[:30] if broken else body, seq)


def test_ingest_stream_first_reading_wins_with_its_rows(spark):
    base = work_dir(spark, "ingest")
    schema = "topic string, payload string, seq long"
    batches = [
        [message("i", 1000, 1, 5.0), message("i", 1000, 2, 6.0, phases=3), message("i", 2000, 3, 7.0), message("i", 3000, 4, 1.0, broken=True)],
        [message("i", 1000, 5, 8.0, phases=3), message("j", 1000, 6, 9.0, phases=1)]]
    for rows in batches:
        write_batches(spark, [rows], schema, f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        SI.start_ingest(stream, base, "inverter", f"{base}/cp", available_now=True).awaitTermination()
    samples = {(r.device_name, r.time.second): (r.seq, r.ac_energy) for r in T.read_table(spark, base, "inverter_samples").collect()}
    assert samples == {("i", 1): (1, 5.0), ("i", 2): (3, 7.0), ("j", 1): (6, 9.0)}
    phases = T.read_table(spark, base, "inverter_phase_samples").groupBy("device_name", "time").count().collect()
    assert sorted((r.device_name, r.time.second, r["count"]) for r in phases) == [("i", 1, 2), ("i", 2, 2), ("j", 1, 1)]
    inputs = T.read_table(spark, base, "inverter_input_samples").collect()
    assert len(inputs) == 3 and all(r.dc_energy is None and r.dc_power == 2.0 for r in inputs)


def meter_batch(spark, rows=((1, AT, 5.0),)):
    df = spark.createDataFrame([("S", "m", seq, at, e, [(1, 2.0), (2, 3.0)]) for seq, at, e in rows],
                               "site_id string, device_name string, seq long, time timestamp, e double, p array<struct<id:int,w:double>>")
    names = ["energy_active_import", "energy_active_export", "energy_apparent_import", "energy_apparent_export", "energy_reactive_import",
             "energy_reactive_export", "power_active", "power_apparent", "power_reactive", "power_factor", "frequency", "voltage_ph", "voltage_pp", "current"]
    phase = ["power_active", "power_apparent", "power_reactive", "power_factor", "voltage_ph", "voltage_pp", "current"]
    return df.select("site_id", "device_name", "seq", "time", *(F.col("e").alias(n) for n in names),
                     F.transform("p", lambda x: F.struct(x["id"], *(x["w"].alias(n) for n in phase))).alias("phases"))


@pytest.mark.parametrize("stop", range(4))
def test_a_batch_that_dies_between_two_tables_is_completed_by_its_retry(spark, monkeypatch, stop):
    """``stop`` tables are moved in before the run dies; at 0 nothing is, but the batch is committed."""
    from sunledger.sources import batches as B

    base, real, moved = work_dir(spark, "retry"), B.move_days, []
    SI.store_readings(meter_batch(spark, [(0, AT - dt.timedelta(hours=1), 1.0)]), base, "meter", "q", 0)

    def dies(spark_, source, path):
        if len(moved) == stop:
            raise RuntimeError("driver lost")
        moved.append(path)
        real(spark_, source, path)

    monkeypatch.setattr(B, "move_days", dies)
    batch = meter_batch(spark)
    if stop < 3:
        with pytest.raises(RuntimeError):
            SI.store_readings(batch, base, "meter", "q", 1)
    else:
        SI.store_readings(batch, base, "meter", "q", 1)
    monkeypatch.undo()
    for _ in range(2):
        assert not SI.store_readings(batch, base, "meter", "q", 1)
        assert T.read_table(spark, base, "meter_phase_samples").count() == 4 and T.read_table(spark, base, "meter_samples").count() == 2
    assert SI.store_readings(meter_batch(spark, [(2, AT, 9.0), (3, AT + dt.timedelta(hours=1), 6.0)]), base, "meter", "q", 2)
    assert sorted(r.seq for r in T.read_table(spark, base, "meter_samples").collect()) == [0, 1, 3]
    assert B.last_batch(spark, base, "q") == 2 and B.last_batch(spark, base, "other") == -1


def test_a_batch_that_dies_while_staging_leaves_nothing(spark, monkeypatch):
    from sunledger.sources import batches as B

    base, real, staged = work_dir(spark, "staging"), B.append_days, []

    def dies(df, path):
        if staged:
            raise RuntimeError("executor lost")
        staged.append(path)
        real(df, path)

    monkeypatch.setattr(B, "append_days", dies)
    with pytest.raises(RuntimeError):
        SI.store_readings(meter_batch(spark), base, "meter", "q", 0)
    monkeypatch.undo()
    assert SI.store_readings(meter_batch(spark), base, "meter", "q", 0)
    assert T.read_table(spark, base, "meter_phase_samples").count() == 2


def test_equal_rejects_of_different_messages_are_each_reported(spark):
    base = work_dir(spark, "rejects")
    schema = "topic string, payload string, seq long"
    batches = [[("t", "", 1), ("t", "", 2), ("t", None, 3), ("t", "x", None)], [("t", "", 4), ("t", None, 5), ("t", "x", None), ("t", "", None)]]
    for number in (0, 0, 1, 1):    # each with a retry
        SI.store_messages(spark.createDataFrame(batches[number], schema), base, "inverter", "q", number)
    found = [(r.payload, r.seq) for r in T.read_table(spark, base, "message_rejects").collect()]
    assert sorted(found, key=str) == sorted([("", 1), ("", 2), (None, 3), ("x", None), ("", 4), (None, 5), ("x", None), ("", None)], key=str)


def test_device_state_survives_batches(spark):
    base = work_dir(spark, "state")
    schema = "site_id string, device_name string, seq long, value double, is_device boolean, fw string"

    def row(seq, device, fw=None):
        return ("S", device, seq, float(seq), fw is not None, fw)

    batches = [[row(1, "a"), row(2, "a", "v1"), row(3, "a"), row(4, "a", "v1")],
               [row(5, "a"), row(6, "b"), row(7, "b", "v1"), row(8, "a", "v2"), row(9, "a")],
               [row(10, "b"), row(11, "a"), row(12, "a", "v2")]]
    for rows in batches:
        write_batches(spark, [rows], schema, f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        SD.start_device_state(stream, base, f"{base}/cp", ["fw"], available_now=True, chunk_rows=2).awaitTermination()
    readings = {r.seq: r.descriptor.fw for r in spark.read.parquet(f"{base}/readings").collect()}
    assert readings == {3: "v1", 5: "v1", 9: "v2", 10: "v1", 11: "v2"}  # 1 and 6 came before any descriptor
    changes = sorted((r.seq, r.device_name, r.fw) for r in spark.read.parquet(f"{base}/changes").collect())
    assert changes == [(2, "a", "v1"), (7, "b", "v1"), (8, "a", "v2")]
    # A new query with a fresh checkpoint goes on from the newest state and keeps what is there.
    write_batches(spark, [[row(13, "b"), row(14, "a")]], schema, f"{base}/in2")
    stream = spark.readStream.schema(schema).parquet(f"{base}/in2")
    SD.start_device_state(stream, base, f"{base}/cp2", ["fw"], available_now=True, chunk_rows=2).awaitTermination()
    readings |= {13: "v1", 14: "v2"}
    assert {r.seq: r.descriptor.fw for r in spark.read.parquet(f"{base}/readings").collect()} == readings
    # A repeated batch starts from the version before it and writes the same.
    SD.process_batch(spark.createDataFrame(batches[2], schema), 2, base, ["fw"], 2)
    assert {r.seq: r.descriptor.fw for r in spark.read.parquet(f"{base}/readings").collect()} == readings


def test_a_late_descriptor_keeps_its_readings(spark):
    base, schema = work_dir(spark, "waiting"), "site_id string, device_name string, seq long, value double, is_device boolean, fw string"

    def row(seq, device, fw=None):
        return ("S", device, seq, float(seq), fw is not None, fw)

    batches = [[row(1, "a"), row(5, "a"), row(6, "b")], [row(3, "a", "v1"), row(7, "a")], [row(8, "b", "late")], [row(9, "b")], [row(10, "c")], []]
    for number, rows in enumerate(batches):
        for _ in range(2):      # each batch is repeated
            SD.process_batch(spark.createDataFrame(rows, schema), number, base, ["fw"], 2)
    readings = {r.seq: r.descriptor.fw for r in spark.read.parquet(f"{base}/readings").collect()}
    assert readings == {5: "v1", 7: "v1", 9: "late"}    # 1 and 6 are older than any descriptor
    dropped = {(r.seq, r.reason) for r in spark.read.parquet(f"{base}/dropped").collect()}
    assert dropped == {(1, SD.NO_DESCRIPTOR), (6, SD.NO_DESCRIPTOR)}
    assert [r.seq for r in spark.read.parquet(f"{base}/waiting/version=5").collect()] == [10]


def test_two_runs_never_share_a_number(spark):
    base = work_dir(spark, "runs")
    assert [SD.run_of(spark, base, f"{base}/cp{i}") for i in (0, 1, 0, 2, 1)] == [0, 1, 0, 2, 1]


def test_duplicates_on_a_stream(spark):
    base = work_dir(spark, "dedup")
    schema = "site_id string, device_name string, time timestamp, seq long"
    rows = [("S", "d", AT, 1), ("S", "d", AT + dt.timedelta(seconds=4), 2)]
    for batch in (rows, [("S", "d", AT, 3), ("S", "e", AT, 4)]):
        write_batches(spark, [batch], schema, f"{base}/in")
        stream = SI.stream_dedup(spark.readStream.schema(schema).parquet(f"{base}/in"))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/cp").trigger(
            availableNow=True).start(f"{base}/out").awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(f"{base}/out").collect()) == [1, 2, 4]


@pytest.mark.parametrize("days_back, day", [(0, dt.date(2024, 1, 2)), (1, dt.date(2024, 1, 1))])
def test_refresh_day_uses_the_local_calendar(spark, monkeypatch, days_back, day):
    calls = []
    monkeypatch.setattr(SL, "run_site_rollup", lambda *a: calls.append(a[2:4]))
    now = dt.datetime(2024, 1, 1, 23, 3, tzinfo=dt.timezone.utc)  # 00:03 in Berlin
    assert SL.refresh_day(spark, "unused", now, "Europe/Berlin", days_back) == day and calls == [(day, day)]


def test_runs_of_consecutive_days():
    d = [dt.date(2024, 1, i) for i in (1, 2, 3, 7, 9, 10)]
    assert SL.runs(d) == [(d[0], d[2]), (d[3], d[3]), (d[4], d[5])] and SL.runs([]) == []


def above_cache(df):
    """Lines of the physical plan that are not inside a cached relation."""
    lines, inside = [], None
    for line in df._jdf.queryExecution().sparkPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is not None and depth > inside:
            continue
        inside = depth if "InMemoryRelation" in line or "InMemoryTableScan" in line else None
        lines.append(line)
    return "\n".join(lines)


def test_device_payloads_are_parsed_once_a_batch(spark, monkeypatch):
    """Every scan of a batch reads what was parsed when it was cached."""
    plans, commit = [], SI.commit_batch

    def spied(spark, store, source, number, rows):
        def told():
            made = rows()
            plans.extend(map(above_cache, made.values()))
            return made
        return commit(spark, store, source, number, told)

    monkeypatch.setattr(SI, "commit_batch", spied)
    store = work_dir(spark, "parsed")
    rows = [("fleet/S/inverter/i/device", '{"serial_number":"A","phases":"x"}', 1), ("fleet/S/meter/m/device", '{"serial_number":"B","phases":2}', 2),
            ("fleet/S/meter/m/device", '{"serial_number":"B","phases":4}', 3), ("fleet/S/meter/m/device", "{", 4),
            ("fleet/S/inverter/i/events", '{"active_code":1,"state":"run","events":[]}', 5), ("fleet/S/inverter/i/events", '{"active_code":"x"}', 6),
            ("fleet/S/meter/m/availability", "connected", 7), ("fleet/S/meter/m/availability", "away", 8), ("fleet/S/pump/p/device", "{}", 9),
            ("inverter/i/events", '{"active_code":2}', 10), ("fleet/S/meter/m/values", "{", 11)]
    batch = spark.createDataFrame(rows, "topic string, payload string, seq long").withColumn("ts", F.lit(AT))
    assert SI.store_device_messages(batch, store)
    assert len(plans) == 3 and not any("from_json" in p for p in plans)
    rejects = {(r.seq, r.reason) for r in T.read_table(spark, store, "message_rejects").collect()}
    assert rejects == {(1, "wrong type phases"), (4, "malformed payload"), (6, "wrong type active_code"), (8, "unknown state"),
                       (9, "unknown topic"), (10, "unknown topic"), (None, "constraint device_phases")}
    assert [(r.seq, r.active_code) for r in T.read_table(spark, store, "inverter_events").orderBy("seq").collect()] == [(5, 1), (10, 2)]
    assert [r.seq for r in T.read_table(spark, store, "availability").collect()] == [7]
    assert [r.serial_number for r in T.read_table(spark, store, "meter_device").collect()] == ["B"]
