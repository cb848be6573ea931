"""Registered queries over stores that streams and jobs fill: what is read back after several batches."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger import KEY
from sunledger.functions.electrical import Grid
from sunledger.operators import fanout, power
from sunledger.plans import kept, realtime
from sunledger.plans.queries import SITE_FIGURES, TZ, _drain, _messages, _rounded, _store, query
from sunledger.session import work_dir
from sunledger.sources import batches, dimensions, driver_tables as A, messages as M, store as S, tables
from sunledger.streaming import device_state as SD, ingest as SI, live as SL

MESSAGE = "topic string, payload string, seq long, ts timestamp"


def in_two_runs(spark: SparkSession, rows: DataFrame, base: str, start: Callable[[DataFrame], object]) -> None:
    """Feed ``rows`` to a stream in two runs on one checkpoint, the earlier half (by seq) first."""
    half = rows.agg(F.floor((F.min("seq") + F.max("seq")) / 2)).first()[0]
    for part in (F.col("seq") <= half, F.col("seq") > half):
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        _drain(start(spark.readStream.schema(rows.schema).parquet(f"{base}/in")))


# --- device, event and availability messages -----------------------------------------

def _topic(suffix: str):
    return F.concat_ws("/", F.lit("fleet"), "site_id", "kind", "device_name", F.lit(suffix))


def device_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors; every 41st has a text for its number of phases, some have none or four."""
    rows = A.readings(spark, sf_dir).where("event_type = 'signup'")
    body = F.struct(F.concat(F.lit("SN"), F.col("user_id") % 3).alias("serial_number"), F.lit("maker").alias("manufacturer"),
                    F.concat(F.lit("fw"), F.floor("value")).alias("firmware_version"), F.lit("float").alias("register_model"),
                    (F.col("user_id") % 300).alias("slave_id"),
                    F.when(F.col("seq") % 41 == 0, "three").otherwise((F.col("user_id") % 5).cast("string")).alias("phases"))
    payload = F.regexp_replace(F.to_json(body), '"phases":"([0-9])"', '"phases":$1')
    return rows.select(_topic("device").alias("topic"), payload.alias("payload"), "seq", F.col("time").alias("ts"))


def inverter_event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event snapshots of the inverters; every 43rd has a text for its code."""
    rows = A.readings(spark, sf_dir).where("kind = 'inverter' AND event_type <> 'signup'")
    code = F.floor("value") % 3
    body = F.struct(F.when(F.col("seq") % 43 == 0, "x").otherwise(code.cast("string")).alias("active_code"),
                    F.when(code == 0, "running").otherwise("fault").alias("state"),
                    F.when(code == 0, F.expr("CAST(array() AS array<string>)")).otherwise(
                        F.array(F.concat(F.lit("E"), code))).alias("events"))
    payload = F.regexp_replace(F.to_json(body), '"active_code":"([0-9])"', '"active_code":$1')
    return rows.select(_topic("events").alias("topic"), payload.alias("payload"), "seq", F.col("time").alias("ts"))


def availability_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "click", "connected").when(F.col("event_type") == "view", "disconnected").otherwise(F.col("event_type"))
    return A.readings(spark, sf_dir).select(_topic("availability").alias("topic"), state.alias("payload"), "seq", F.col("time").alias("ts"))


@query("json_scan_device")
def json_scan_device(spark, sf_dir):
    parsed = M.parse_messages(device_messages(spark, sf_dir), "meter", "device")
    return parsed.select(*KEY, "seq", "malformed", *(F.when(~F.col("malformed"), F.col(c)).alias(c) for c in (
        "serial_number", "firmware_version", "slave_id", "phases")))


@query("json_scan_events")
def json_scan_events(spark, sf_dir):
    parsed = M.parse_messages(inverter_event_messages(spark, sf_dir), "inverter", "events")
    return parsed.select(*KEY, "seq", "malformed", F.when(~F.col("malformed"), F.col("active_code")).alias("active_code"), "state",
                         F.size("events").alias("n_events"))


@query("json_scan_availability")
def json_scan_availability(spark, sf_dir):
    """States of both classes; other texts are rejects with a reason."""
    messages = availability_messages(spark, sf_dir)
    known = M.parse_availability(messages, "inverter").unionByName(M.parse_availability(messages, "meter")).where(
        F.col("state").isin(M.AVAILABILITY)).select("topic", "seq", "state", F.lit(None).cast("string").alias("reason"))
    return known.unionByName(M.rejected_messages(messages).select("topic", "seq", F.lit(None).cast("string").alias("state"), "reason"))


def _device_store(spark: SparkSession, sf_dir: str) -> str:
    base = work_dir(spark, "devices")
    rows = device_messages(spark, sf_dir).unionByName(inverter_event_messages(spark, sf_dir)).unionByName(availability_messages(spark, sf_dir))
    in_two_runs(spark, rows, base, lambda s: SI.start_device_ingest(s, base, f"{base}/checkpoint", available_now=True))
    return base


@query("stream_device_ingest")
def stream_device_ingest(spark, sf_dir):
    """Stored descriptors of both kinds after two runs of the stream."""
    base = _device_store(spark, sf_dir)
    cols = [*KEY, "serial_number", "firmware_version", "slave_id", "phases", "first_seen", "last_seen"]
    return tables.read_table(spark, base, "inverter_device").select(cols).unionByName(
        tables.read_table(spark, base, "meter_device").select(cols))


@query("stream_device_events")
def stream_device_events(spark, sf_dir):
    """Stored event snapshots (those that differ from the one before) and rejects by reason."""
    base = _device_store(spark, sf_dir)
    events = tables.read_table(spark, base, "inverter_events").select(
        *KEY, "seq", "active_code", "state", F.array_join("events", ",").alias("events"), F.lit(None).cast("string").alias("reason"))
    rejects = tables.read_table(spark, base, "message_rejects").groupBy("reason").agg(F.count(F.lit(1)).alias("seq"))
    return events.unionByName(rejects.select("reason", "seq"), allowMissingColumns=True)


@query("stream_availability")
def stream_availability(spark, sf_dir):
    """Stored changes of availability."""
    return tables.read_table(spark, _device_store(spark, sf_dir), "availability").drop("day")


@query("stream_json_rejects_fields")
def stream_json_rejects_fields(spark, sf_dir):
    """Rejects of fields that are not of their type and of payloads without values, over two runs."""
    base, seq = work_dir(spark, "ingest"), F.col("seq")
    payload = (F.when(seq % 89 == 0, F.regexp_replace("payload", '"ac_energy":[^,]*', '"ac_energy":"abc"'))
               .when(seq % 83 == 0, F.regexp_replace("payload", '"id":1,"ac_voltage":[^,]*', '"id":1,"ac_voltage":"x"'))
               .when(seq % 79 == 0, F.concat(F.regexp_extract("payload", '^([{]"time":[0-9]+)', 1), F.lit("}"))).otherwise(F.col("payload")))
    rows = _messages(spark, sf_dir, "inverter").withColumn("payload", payload)
    in_two_runs(spark, rows, base, lambda s: SI.start_ingest(s, base, "inverter", f"{base}/checkpoint", available_now=True))
    stored = tables.read_table(spark, base, "inverter_samples").select(F.lit("stored").alias("reason"), "seq")
    return stored.unionByName(tables.read_table(spark, base, "message_rejects").select("reason", "seq"))


# --- meters ------------------------------------------------------------------------------

METER_OUT = ["energy_active_import", "energy_apparent_import", "energy_apparent_export", "energy_reactive_import", "energy_reactive_export",
             "power_active", "power_apparent", "power_reactive", "voltage_ph", "current"]


def _meter_rows(spark: SparkSession, base: str) -> DataFrame:
    at = [*KEY, "time"]
    phases = tables.read_table(spark, base, "meter_phase_samples").select(
        *at, "phase_id", F.col("power_reactive").alias("phase_reactive"), F.col("current").alias("phase_current"))
    return tables.read_table(spark, base, "meter_samples").select(*at, "seq", *METER_OUT).join(phases, at)


def _telegram_store(spark: SparkSession, sf_dir: str, grid: Grid) -> str:
    base = work_dir(spark, "telegrams")
    rows = A.telegrams(spark, sf_dir).select(*KEY, "seq", "received_at", "telegram")
    in_two_runs(spark, rows, base, lambda s: SI.start_telegrams(s, base, f"{base}/checkpoint", grid, available_now=True))
    return base


@query("telegram_to_meter_samples")
def telegram_to_meter_samples(spark, sf_dir):
    """Samples and phases of streamed telegrams, the grid taken to lag."""
    return _meter_rows(spark, _telegram_store(spark, sf_dir, Grid(0.98, 50.0, False)))


@query("telegram_to_meter_samples_leading")
def telegram_to_meter_samples_leading(spark, sf_dir):
    """The same with a leading grid, and the identities and rejects that were stored with them."""
    base = _telegram_store(spark, sf_dir, Grid(0.9, 50.0, True))
    rows = _meter_rows(spark, base).where("phase_id = 2").withColumn("told", F.lit("sample"))
    devices = tables.read_table(spark, base, "meter_device").select(
        *KEY, F.concat(F.lit("device "), "serial_number", F.lit(" "), "firmware_version", F.lit(" "), "phases").alias("told"),
        F.col("first_seen").alias("time"))
    rejects = tables.read_table(spark, base, "message_rejects").select(F.concat(F.lit("reject "), "reason").alias("told"), "seq")
    return rows.unionByName(devices, allowMissingColumns=True).unionByName(rejects, allowMissingColumns=True)


@query("meter_reading_pipeline")
def meter_reading_pipeline(spark, sf_dir):
    """Register readings of both maps, each without the quantities its map lacks, stored in two batches."""
    base, odd = work_dir(spark, "registers"), F.col("seq") % 2 == 1
    rows = A.meter_readings(spark, sf_dir).withColumns({
        "register_map": F.when(odd, "sunspec").otherwise("proprietary"),
        "power_reactive": F.when(F.col("seq") % 3 == 0, -F.col("power_reactive")).otherwise(F.col("power_reactive")),
        "current": F.when(odd, F.col("current")),
        **{f"energy_reactive_{s}": F.when(~odd, F.col(f"energy_reactive_{s}")) for s in ("import", "export")},
        **{f"energy_apparent_{s}": F.when(odd, F.col(f"energy_apparent_{s}")) for s in ("import", "export")}})
    for number, part in enumerate((F.col("seq") % 10 < 5, F.col("seq") % 10 >= 5, F.col("seq") % 10 >= 5)):
        SI.store_register_readings(rows.where(part), base, "registers", min(number, 1))     # the last is a retry
    return _meter_rows(spark, base)


# --- readings ahead of their descriptor ---------------------------------------------------------

@query("stream_device_waiting")
def stream_device_waiting(spark, sf_dir):
    """Every reading with its descriptor; those of the first half come a batch late, so its readings wait for them."""
    base = work_dir(spark, "waiting")
    rows = A.readings(spark, sf_dir).select(
        *KEY, "seq", "value", (F.col("event_type") == "signup").alias("is_device"), F.concat(F.lit("SN"), F.col("user_id") % 3).alias("serial_number"))
    half = rows.agg(F.floor((F.min("seq") + F.max("seq")) / 2)).first()[0]
    ahead = ~F.col("is_device") & (F.col("seq") <= half)
    for part in (ahead, ~ahead):
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        _drain(SD.start_device_state(stream, f"{base}/out", f"{base}/checkpoint", ["serial_number"], available_now=True, chunk_rows=1000))
    found = spark.read.parquet(f"{base}/out/readings").select(*KEY, "seq", "value", "descriptor.serial_number")
    last = max(SD.list_versions(spark, f"{base}/out/waiting"))
    return found.unionByName(spark.read.parquet(f"{base}/out/waiting/version={last}").select(
        *KEY, "seq", "value", F.lit("waits").alias("serial_number")))


# --- roster and sites ----------------------------------------------------------------------

EARLIER, LATER = dt.datetime(2024, 3, 1, 6), dt.datetime(2024, 3, 2, 6, 30)


@query("registry_store_sync")
def registry_store_sync(spark, sf_dir):
    """The stored roster after two configurations: the second empties some sites, sites with faulty rows keep what they have."""
    store = work_dir(spark, "roster")
    dimensions.sync_registry_store(spark, store, A.fleet_roster(spark, sf_dir), now=EARLIER)
    configured = A.configured_roster(spark, sf_dir)
    emptied = A.fleet_roster(spark, sf_dir).select("site_id").distinct().where(F.substring("site_id", 2, 9).cast("int") % 7 == 1)
    faulty = F.when(F.col("device_name").endswith("77"), "bad name").otherwise(F.col("device_name"))
    dimensions.sync_registry_store(spark, store, configured.withColumn("device_name", faulty),
                                   configured.select("site_id").unionByName(emptied), LATER)
    return tables.read_dims(spark, store)[0]


@query("site_store_sync")
def site_store_sync(spark, sf_dir):
    """The stored site settings after two configurations; out of range settings are left out."""
    store, n = work_dir(spark, "sites"), F.substring("site_id", 2, 9).cast("int")
    sites = A.nation_sites(spark, sf_dir)
    dimensions.sync_site_store(spark, store, sites, EARLIER)
    again = sites.where(n % 3 != 0).select(
        "site_id", F.when(n % 2 == 0, n * 1.5).alias("latitude"), F.when(n % 2 == 0, n * 2.5).alias("longitude"),
        F.when(n % 4 == 0, -2.0).when(n % 5 == 4, 30.0).alias("horizon_deg"))
    dimensions.sync_site_store(spark, store, again, LATER)
    return tables.read_dims(spark, store)[1]


# --- power that is always up to date ----------------------------------------------------------

def _realtime_store(spark: SparkSession, sf_dir: str) -> str:
    """A store refreshed up to 19 January that then got the rest of its samples, a tenth of them late."""
    store, late = work_dir(spark, "realtime"), F.col("seq") % 10 == 3
    early = (F.col("time") < dt.datetime(2024, 1, 20, 3)) & ~late
    both = {"inverter": A.inverter_samples(spark, sf_dir), "meter": A.meter_samples(spark, sf_dir)}
    for kind, df in both.items():
        S.append_days(df.where(early), f"{store}/{kind}_samples")
    for table in realtime.WIDTHS:
        realtime.refresh_power_range(spark, store, table, dt.datetime(2024, 1, 19, 12, 3, 20), dt.timedelta(days=400), dt.timedelta(minutes=10))

    def rest() -> dict[str, DataFrame]:
        rows = {kind: df.where(~early) for kind, df in both.items()}
        noted = [realtime.late_buckets(spark, store, power.power_rows(df, kind)) for kind, df in rows.items()]
        return {"power_late": noted[0].unionByName(noted[1]), **{f"{kind}_samples": df for kind, df in rows.items()}}

    batches.commit_batch(spark, store, "late", 0, rest)
    return store


SPAN = dt.datetime(2023, 1, 1), dt.datetime(2025, 1, 1)


@query("power_realtime")
def power_realtime(spark, sf_dir):
    """Stored buckets, late ones and those past the refreshed end, from one view."""
    return realtime.power_realtime(spark, _realtime_store(spark, sf_dir), "power_5min", *SPAN)


@query("power_refresh_late")
def power_refresh_late(spark, sf_dir):
    """Half-minute buckets that are stored after the late ones were made anew and the range was refreshed to its end."""
    store = _realtime_store(spark, sf_dir)
    realtime.refresh_late(spark, store)
    realtime.refresh_power_range(spark, store, "power_30sec", dt.datetime(2024, 6, 1), dt.timedelta(days=140), dt.timedelta(0))
    return tables.read_table(spark, store, "power_30sec").drop("day")


# --- rollups from kept buckets ------------------------------------------------------------------

def kept_store(spark: SparkSession, sf_dir: str) -> str:
    """A store that began to keep buckets with a third of its samples, got a second third and a retry of it, and a third of each
    bucket's samples later; its older days were compacted between the batches."""
    store = work_dir(spark, "kept")
    both = {"inverter": A.inverter_samples(spark, sf_dir), "meter": A.meter_samples(spark, sf_dir)}
    A.registry(spark, sf_dir).write.parquet(f"{store}/device_registry")
    A.sites(spark, sf_dir).write.parquet(f"{store}/site")
    for kind, df in both.items():
        S.append_days(df.where("seq % 3 = 0"), f"{store}/{kind}_samples")
    kept.start_buckets(spark, store)

    def batch(part: int) -> dict[str, DataFrame]:
        rows = {kind: df.where(F.col("seq") % 3 == part) for kind, df in both.items()}
        added = {t: x for kind, df in rows.items() for t, x in kept.kept_rows(spark, store, kind, df).items()}
        return {**added, **{f"{kind}_samples": df for kind, df in rows.items()}}

    for number, part in enumerate((1, 1, 2)):
        batches.commit_batch(spark, store, "kept", min(number, part - 1), lambda: batch(part))
        S.apply_compaction(spark, store, dt.datetime(2024, 1, 25) + dt.timedelta(days=9 * part))
    return store


@query("live_rollup_from_buckets")
def live_rollup_from_buckets(spark, sf_dir):
    """The stored site balance of a live rollup that reads kept buckets instead of samples."""
    store = kept_store(spark, sf_dir)
    both = [spark.readStream.schema(tables.TABLES[t]).parquet(f"{store}/{t}").select("site_id", "time") for t in ("inverter_samples", "meter_samples")]
    _drain(SL.start_live_rollup(both[0].unionByName(both[1]), store, TZ, f"{store}/_checkpoint", available_now=True))
    return _rounded(tables.read_table(spark, store, "site_energy"), SITE_FIGURES)


# --- lifecycle ---------------------------------------------------------------------------------

@query("compaction_store")
def compaction_store(spark, sf_dir):
    """All sample tables, counted by day after a compaction of the whole store next to which rows were added."""
    store = _store(spark, sf_dir)
    full = fanout.quantise_inverter(A.inverter_readings(spark, sf_dir))
    meters = fanout.quantise_meter(A.meter_readings(spark, sf_dir))
    for name, df in (("inverter_phase_samples", fanout.explode_phases(full, "inverter")), ("inverter_input_samples", fanout.explode_inputs(full)),
                     ("meter_phase_samples", fanout.explode_phases(meters, "meter"))):
        early = F.to_date("time") < dt.date(2024, 1, 10)
        S.append_days(df.where(early), f"{store}/{name}")
        S.append_days(df.where(~early), f"{store}/{name}")
    S.apply_compaction(spark, store, dt.datetime(2024, 1, 25))
    S.insert_first(spark, fanout.explode_phases(full, "inverter"), f"{store}/inverter_phase_samples", [*KEY, "time", "phase_id"])   # nothing new
    S.apply_compaction(spark, store, dt.datetime(2024, 2, 20))
    sums = {"inverter_samples": "seq", "meter_samples": "seq", "inverter_phase_samples": "phase_id", "inverter_input_samples": "input_id",
            "meter_phase_samples": "phase_id"}
    out = [tables.read_table(spark, store, t).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("total")).withColumn("name", F.lit(t))
           for t, c in sums.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])
