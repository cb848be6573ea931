"""Messages and telegrams to the tables of a store, as streams.

Every micro-batch goes into all of its tables at once (``sources/batches.py``): samples, phases, inputs, events, states and rejects
become visible together, and a repeated batch adds nothing. Descriptors and last states are snapshots that follow; a repeated
batch makes the same ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from sunledger import KEY
from sunledger.functions.electrical import Grid, grid_assumption_derive
from sunledger.functions.numeric import apparent_energy, current_total, reactive_energy
from sunledger.operators import fanout
from sunledger.operators.devices import device_upsert, meter_identity_nulls
from sunledger.operators.ordered import change_gate, first_wins, latest
from sunledger.operators.power import power_rows
from sunledger.operators.validation import rejected_rows, rule_sets, valid_rows
from sunledger.plans.kept import kept_rows
from sunledger.plans.realtime import late_buckets
from sunledger.schemas import TABLES
from sunledger.sources.batches import commit_batch, source_of
from sunledger.sources.dimensions import keep_latest, write_dimension
from sunledger.sources.messages import AVAILABILITY, parse_messages, read_messages, read_rows, rejected_messages
from sunledger.sources.store import new_rows
from sunledger.sources.tables import read_dimension, table_path
from sunledger.sources.telegrams import parse_telegrams, telegram_devices, telegram_readings, telegram_rejects

LATE = "1 hour"


def stream_dedup(readings: DataFrame, late: str = LATE) -> DataFrame:
    """First reading per (device, time) on a stream; state is kept for ``late``."""
    return readings.withWatermark("time", late).dropDuplicatesWithinWatermark([*KEY, "time"])


def _arrival(df: DataFrame) -> Column:
    """When a message came: its own ``ts``, else now."""
    return F.coalesce(F.col("ts").cast("timestamp"), F.current_timestamp()) if "ts" in df.columns else F.current_timestamp()


def _rejects(df: DataFrame) -> DataFrame:
    """Rows of ``message_rejects``, in the day of their arrival."""
    return df.withColumn("day", F.to_date(_arrival(df))).select(*TABLES["message_rejects"].fieldNames())


def _checked(rows: DataFrame, rules: str) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the constraints of their table, and the others as rejects."""
    rules = rule_sets()[rules]
    bad = rejected_rows(rows, rules).select(
        F.concat_ws("/", *KEY).alias("topic"), F.to_json(F.struct(*rows.columns)).alias("payload"),
        F.lit(None).cast("long").alias("seq"), F.concat(F.lit("constraint "), F.array_join("violations", ", ")).alias("reason"))
    return valid_rows(rows, rules), _rejects(bad)


def _fanned_out(batch: DataFrame, store: str, kind: str, rejects: list[DataFrame]) -> dict[str, DataFrame]:
    """The rows of a batch of readings, by table. A reading whose (device, time) is stored already is lost as a whole."""
    fresh = new_rows(batch.sparkSession, batch, table_path(store, f"{kind}_samples"), [*KEY, "time"])
    phases, bad = _checked(fanout.explode_phases(fresh, kind, count=None), "phase_samples")
    tables, rejects = {f"{kind}_phase_samples": phases}, [*rejects, bad]
    if kind == "inverter":
        tables["inverter_input_samples"], bad = _checked(fanout.explode_inputs(fresh, count=None, hybrid=None, scale=False), "input_samples")
        rejects.append(bad)
    rows = fanout.inverter_rows if kind == "inverter" else fanout.meter_rows
    samples = rows(fresh, scale=False)
    late = late_buckets(batch.sparkSession, store, power_rows(samples, kind))
    if late is not None:
        tables["power_late"] = late
    # Published before the samples, whose arrival starts the rollups.
    tables |= kept_rows(batch.sparkSession, store, kind, samples)
    return {**tables, "message_rejects": reduce(DataFrame.unionByName, rejects), f"{kind}_samples": samples}


def store_readings(batch: DataFrame, store: str, kind: str, source: str | None = None, number: int = 0,
                   rejects: list[DataFrame] | None = None) -> bool:
    """Fan one batch of parsed readings out into the tables of a kind; False if it is stored already.

    Phases and inputs carry their numbers; those that break a constraint go to ``message_rejects``, with ``rejects``. Without a
    ``source`` the batch is one of its own.
    """
    # Several tables are written from the batch: parse it once.
    batch = first_wins(batch.withColumn("day", F.to_date("time")), [*KEY, "time"]).persist()
    try:
        return commit_batch(batch.sparkSession, store, source or uuid.uuid4().hex, number,
                            lambda: _fanned_out(batch, store, kind, rejects or []))
    finally:
        batch.unpersist()


def _mine(messages: DataFrame, kind: str) -> DataFrame:
    """Of the messages of both kinds, each is reported by one: its own, or the inverters' where the topic names none."""
    meters = F.coalesce(F.try_element_at(F.split("topic", "/"), F.lit(-3)) == "meter", F.lit(False))
    return messages.where(meters if kind == "meter" else ~meters)


def store_messages(batch: DataFrame, store: str, kind: str, source: str | None = None, number: int = 0) -> bool:
    """Store the ``values`` messages of a kind, and what cannot be read of the batch as rejects with a reason."""
    batch = batch.persist()
    try:
        rejects = _rejects(rejected_messages(_mine(batch, kind)))
        readings = parse_messages(batch, kind).where(~F.col("malformed")).drop("malformed")
        return store_readings(readings, store, kind, source, number, [rejects])
    finally:
        batch.unpersist()


# --- descriptors, events, availability -------------------------------------------

EVENT = ["active_code", "state", "events"]


def _gated(batch: DataFrame, store: str, last: str, cols: list[str], keys: list[str]) -> DataFrame:
    """Snapshots of a batch that differ from the one before, which may be in an earlier batch."""
    known = read_dimension(batch.sparkSession, store, last)
    names = known.columns
    marked = known.withColumn("_known", F.lit(True)).unionByName(batch.select(*names, F.lit(False).alias("_known")))
    # What an earlier batch accepted comes first, whatever its number.
    newer = marked.join(known.select(*keys, F.col("seq").alias("_last")), keys, "left").where(
        F.col("_known") | F.col("_last").isNull() | (F.col("seq") > F.col("_last"))).drop("_last")
    return change_gate(newer, keys, "seq", cols).where(~F.col("_known")).drop("_known").withColumn("day", F.to_date("ts"))


def store_device_messages(batch: DataFrame, store: str, source: str | None = None, number: int = 0) -> bool:
    """Store the ``device``, ``events`` and ``availability`` messages of a batch of both kinds; False if it is stored already.

    Descriptors keep their first sighting and get a new last one; a new serial adds a row; one that breaks a constraint is
    rejected. Events and states are stored when they differ from the last accepted ones of their device, in order of ``seq``;
    a message that is not newer than those is a repetition. Unreadable messages of these types go to ``message_rejects``.
    """
    spark = batch.sparkSession
    # Read by a dozen scans: payloads are parsed once, for all of them.
    read = read_messages(batch.withColumn("ts", _arrival(batch)), ["device", "events", "availability"]).persist()
    try:
        rejects, devices = [_rejects(read.where(F.col("reason").isNotNull()))], {}
        for kind in ("inverter", "meter"):
            seen = read_rows(read, kind, "device")
            if kind == "meter":
                seen = meter_identity_nulls(seen)
            rules = rule_sets()[f"{kind}_device"]
            devices[kind] = valid_rows(seen, rules)
            rejects.append(_checked(seen.select(*KEY, "ts", *[f.name for f in TABLES[f"{kind}_device"] if f.name in seen.columns and f.name not in KEY]),
                                    f"{kind}_device")[1])
        events = read_rows(read, "inverter", "events")
        known = F.col("kind").isin(list(devices)) & (F.col("suffix") == "availability") & F.col("payload").isin(AVAILABILITY)
        states = read.where(known).select(*KEY, "kind", "seq", "ts", F.col("payload").alias("state"))
        stored = commit_batch(spark, store, source or uuid.uuid4().hex, number, lambda: {
            "inverter_events": _gated(events, store, "last_events", EVENT, KEY),
            "availability": _gated(states, store, "last_availability", ["state"], [*KEY, "kind"]),
            "message_rejects": reduce(DataFrame.unionByName, rejects)})
        # A run that died behind the commit comes again and makes these snapshots then.
        keep_latest(spark, store, "last_events", events, KEY)
        keep_latest(spark, store, "last_availability", states, [*KEY, "kind"])
        for kind, seen in devices.items():
            names = [f.name for f in TABLES[f"{kind}_device"] if f.name not in ("first_seen", "last_seen")]
            # Of several sightings at one instant, the last message counts.
            rows = latest(seen, [*KEY, "serial_number", "ts"], "seq").select(*names, "ts")
            spans = TABLES[f"{kind}_device"]
            write_dimension(spark, store, f"{kind}_device", lambda current: device_upsert(
                rows.select(*(F.col(n).cast(spans[n].dataType) for n in names), "ts"), current))
        return stored
    finally:
        read.unpersist()


# --- meters --------------------------------------------------------------------------

def store_telegrams(batch: DataFrame, store: str, grid: Grid = Grid(), source: str | None = None, number: int = 0) -> bool:
    """Store raw telegrams (site_id, device_name, seq, received_at, telegram): samples, phases, identity, rejects.

    What a power-only meter does not measure comes from the assumed ``grid``. A telegram that cannot be read is a reject with its
    reason and its text; its reading does not exist.
    """
    spark = batch.sparkSession
    parsed = parse_telegrams(batch).persist()
    try:
        rejects = telegram_rejects(parsed).select(F.concat_ws("/", *KEY).alias("topic"), F.col("telegram").alias("payload"), "seq",
                                                  F.col("received_at").alias("ts"), F.col("reject_reason").alias("reason"))
        readings = telegram_readings(parsed).withColumnRenamed("received_at", "time")
        full = fanout.quantise_meter(grid_assumption_derive(readings, grid))
        stored = store_readings(_kilo(full), store, "meter", source, number, [_rejects(rejects)])
        seen = telegram_devices(readings).withColumnRenamed("time", "ts")
        names = ["serial_number", "manufacturer", "model", "firmware_version", "phases"]
        kinds = TABLES["meter_device"]
        seen = latest(seen, [*KEY, "serial_number", "ts"], "seq").select(
            *KEY, *(F.col(n) if n in names else F.lit(None).cast(kinds[n].dataType).alias(n)
                    for n in kinds.fieldNames() if n not in (*KEY, "first_seen", "last_seen")), "ts")
        write_dimension(spark, store, "meter_device", lambda current: device_upsert(seen, current))
        return stored
    finally:
        parsed.unpersist()


def _kilo(readings: DataFrame) -> DataFrame:
    """Energies of quantised readings in kWh, numbered phases: the form that messages have."""
    energy = {n: F.col(n) / 1000.0 for n, quantity in fanout.METER_FIELDS.items() if quantity == "energy"}
    numbered = F.transform("phases", lambda x, i: F.struct((i + 1).alias("id"), *(x[n].alias(n) for n in fanout.METER_PHASE_FIELDS)))
    return readings.withColumns(energy).withColumn("phases", numbered)


def complete_register_readings(readings: DataFrame) -> DataFrame:
    """Meter readings of either register map with the quantities that the map lacks, before rounding.

    ``register_map`` is ``sunspec`` (no reactive energy: it follows from apparent and active, signed by the reactive power) or
    ``proprietary`` (no apparent energy: it follows from active and reactive; no total current: the sum of the phases').
    """
    proprietary = F.coalesce(F.col("register_map") == "proprietary", F.lit(False))
    cols = {"current": current_total(F.transform("phases", lambda p: p["current"]), "current", "register_map")}
    for side in ("import", "export"):
        active, apparent, reactive = (F.col(f"energy_{k}_{side}") for k in ("active", "apparent", "reactive"))
        cols[f"energy_reactive_{side}"] = F.when(proprietary, reactive).otherwise(reactive_energy(apparent, active, F.col("power_reactive")))
        cols[f"energy_apparent_{side}"] = F.when(proprietary, apparent_energy(active, reactive)).otherwise(apparent)
    return readings.withColumns(cols)


def store_register_readings(batch: DataFrame, store: str, source: str | None = None, number: int = 0) -> bool:
    """Store meter readings as the registers give them (Wh, ``register_map``, ``phase_count``): derive, round, fan out."""
    cut = F.slice("phases", F.lit(1), F.greatest(F.lit(1), F.least(F.col("phase_count").cast("int"), F.lit(3))))
    full = fanout.quantise_meter(complete_register_readings(batch.withColumn("phases", cut)))
    return store_readings(_kilo(full), store, "meter", source, number)


# --- streams ---------------------------------------------------------------------------

def _start(rows: DataFrame, checkpoint: str, store_batch: Callable[[DataFrame, str, int], bool], available_now: bool,
           every: str) -> StreamingQuery:
    """A query that hands each batch on with the id of its checkpoint and its number."""
    spark = rows.sparkSession
    writer = rows.writeStream.foreachBatch(lambda b, i: store_batch(b, source_of(spark, checkpoint), i)).option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def start_ingest(messages: DataFrame, store: str, kind: str, checkpoint: str,
                 available_now: bool = False, every: str = "1 minute") -> StreamingQuery:
    """Parse the ``values`` messages of a kind and store them; what cannot be read goes to ``message_rejects``."""
    return _start(messages, checkpoint, lambda b, s, i: store_messages(b, store, kind, s, i), available_now, every)


def start_device_ingest(messages: DataFrame, store: str, checkpoint: str, available_now: bool = False,
                        every: str = "1 minute") -> StreamingQuery:
    """Follow descriptors, events and availability of both kinds."""
    return _start(messages, checkpoint, lambda b, s, i: store_device_messages(b, store, s, i), available_now, every)


def start_telegrams(telegrams: DataFrame, store: str, checkpoint: str, grid: Grid = Grid(), available_now: bool = False,
                    every: str = "1 minute") -> StreamingQuery:
    """Follow raw telegrams into the meter tables."""
    return _start(telegrams, checkpoint, lambda b, s, i: store_telegrams(b, store, grid, s, i), available_now, every)
