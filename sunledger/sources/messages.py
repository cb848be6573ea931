"""JSON messages: topic ``<base>/<class>/<name>/<suffix>`` and one payload per reading."""

from __future__ import annotations

from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sunledger import KEY
from sunledger.functions import numeric as N
from sunledger.operators.fanout import INVERTER_INPUT_FIELDS, INVERTER_PHASE_FIELDS, METER_PHASE_FIELDS
from sunledger.schemas import PAYLOADS

AVAILABILITY = ["connected", "disconnected"]
# The field without which a payload is not of its type.
REQUIRED = {"values": "time", "events": "active_code", "device": "serial_number"}
BAD_TOPIC, BAD_PAYLOAD, BAD_STATE = "unknown topic", "malformed payload", "unknown state"
WRONG_TYPE, NO_VALUES = "wrong type", "no values"
_UNREAD = "_unread"     # the text of a payload with a field that is not of its type


def split_topic(messages: DataFrame) -> DataFrame:
    """Add ``site_id, kind, device_name, suffix``, read from the right.

    The base may hold slashes itself; its last segment names the site.
    """
    parts = F.split("topic", "/")

    def at(i: int) -> Column:
        return F.try_element_at(parts, F.lit(-i))

    return messages.withColumns({
        "site_id": at(4), "kind": at(3), "device_name": at(2), "suffix": at(1)})


def _parsed(payload: Column, schema: str) -> Column:
    return F.from_json(payload, f"{schema}, {_UNREAD} string", {"columnNameOfCorruptRecord": _UNREAD})


@lru_cache
def _struct_of(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


def _as_text(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"array<{_as_text(kind.elementType)}>"
    if isinstance(kind, T.StructType):
        return "struct<" + ",".join(f"{f.name}:{_as_text(f.dataType)}" for f in kind) + ">"
    return "string"


def _wrong(raw: Column, typed: Column, kind: T.DataType) -> Column:
    """Whether a value is there as text and not as its type, at any depth."""
    lost = raw.isNotNull() & typed.isNull()
    if isinstance(kind, T.ArrayType):
        pairs = F.zip_with(raw, typed, lambda a, b: F.coalesce(_wrong(a, b, kind.elementType), F.lit(False)))
        return lost | F.coalesce(F.exists(pairs, lambda x: x), F.lit(False))
    if isinstance(kind, T.StructType):
        return lost | reduce(or_, [F.coalesce(_wrong(raw[f.name], typed[f.name], f.dataType), F.lit(False)) for f in kind])
    return lost


def _texts(payload: Column, schema: str) -> Column:
    return F.from_json(payload, ", ".join(f"{f.name} {_as_text(f.dataType)}" for f in _struct_of(schema).fields))


def payload_problem(payload: Column, parsed: Column, schema: str, suffix: str, texts: Column | None = None) -> Column:
    """Why a payload cannot be stored, NULL if it can. Only one with a fault is read a second time, to name the fields."""
    fields = _struct_of(schema).fields
    texts = _texts(payload, schema) if texts is None else texts
    names = F.array_compact(F.array(*(F.when(F.coalesce(_wrong(texts[f.name], parsed[f.name], f.dataType), F.lit(False)), f.name) for f in fields)))
    problem = F.when(parsed.isNull(), BAD_PAYLOAD).when(
        parsed[_UNREAD].isNotNull(), F.when(F.size(names) > 0, F.concat(F.lit(f"{WRONG_TYPE} "), F.array_join(names, ", "))).otherwise(BAD_PAYLOAD)
    ).when(parsed[REQUIRED[suffix]].isNull(), BAD_PAYLOAD)
    if suffix == "values":
        problem = problem.when(F.coalesce(*(parsed[f.name].cast("string") for f in fields if f.name != "time")).isNull(), NO_VALUES)
    return problem


def parse_messages(messages: DataFrame, kind: str, suffix: str = "values") -> DataFrame:
    """Typed rows of one message type, on a batch or a stream.

    ``malformed`` is true where the payload is not JSON of that type: cut off, a field of another type (an absent field is
    none), no time, or nothing but a time.
    """
    schema = PAYLOADS[kind, suffix]
    df = split_topic(messages).where((F.col("kind") == kind) & (F.col("suffix") == suffix))
    df = df.withColumn("_p", _parsed(F.col("payload"), schema))
    carried = [c for c in ("seq", "ts") if c in messages.columns]
    bad = payload_problem(F.col("payload"), F.col("_p"), schema, suffix).isNotNull()
    df = df.select(*KEY, "topic", *carried, *(F.col(f"_p.{f.name}") for f in _struct_of(schema)), bad.alias("malformed"))
    if suffix == "values":
        df = df.withColumn("time", F.timestamp_millis("time"))
    return df


def _is(kind: str, suffix: str) -> Column:
    return (F.col("kind") == kind) & (F.col("suffix") == suffix)


def _reason(problem: Column) -> Column:
    """Why a message of a split topic is a reject, NULL if it is none; ``problem`` is that of its payload."""
    state = F.col("kind").isin("inverter", "meter") & (F.col("suffix") == "availability")
    return (
        F.when(F.col("site_id").isNull() | ~F.coalesce(reduce(or_, [*(_is(*t) for t in PAYLOADS), state]), F.lit(False)), BAD_TOPIC)
        .when(state & ~F.coalesce(F.col("payload").isin(AVAILABILITY), F.lit(False)), BAD_STATE)
        .when(~state, F.coalesce(problem, F.when(F.col("payload").isNull(), BAD_PAYLOAD))))


def rejected_messages(messages: DataFrame) -> DataFrame:
    """topic, payload, seq, reason of the messages that no parser takes: unknown topics and payloads of another form.

    ``ts`` is carried if there is one.
    """
    problem = F.lit(None).cast("string")
    for (kind, suffix), schema in PAYLOADS.items():
        problem = F.when(_is(kind, suffix), payload_problem(F.col("payload"), _parsed(F.col("payload"), schema), schema, suffix)).otherwise(problem)
    carried = ["ts"] if "ts" in messages.columns else []
    return split_topic(messages).select("topic", "payload", "seq", *carried, _reason(problem).alias("reason")).where("reason IS NOT NULL")


def read_messages(messages: DataFrame, suffixes: list[str]) -> DataFrame:
    """Every message with one of ``suffixes``, its payload read once: persist it and take parts with ``read_rows``.

    Columns: topic, payload, seq, ts, the parts of the topic, a struct ``_<kind>_<suffix>`` of the typed fields for each type,
    ``problem`` of the payload and ``reason`` for rejecting the message; both NULL where there is none.
    """
    df = split_topic(messages).where(F.col("suffix").isin(suffixes))
    types = {t: (f"_{t[0]}_{t[1]}", schema) for t, schema in PAYLOADS.items() if t[1] in suffixes}
    df = df.withColumns({c: F.when(_is(*t), _parsed(F.col("payload"), schema)) for t, (c, schema) in types.items()})
    # In a column of its own, or it would be read once for each field that is looked at.
    df = df.withColumns({f"{c}_texts": F.when(F.col(c)[_UNREAD].isNotNull(), _texts(F.col("payload"), schema)) for c, schema in types.values()})
    problem = F.lit(None).cast("string")
    for (kind, suffix), (c, schema) in types.items():
        problem = F.when(_is(kind, suffix), payload_problem(F.col("payload"), F.col(c), schema, suffix, F.col(f"{c}_texts"))).otherwise(problem)
    df = df.withColumn("problem", problem).withColumn("reason", _reason(F.col("problem")))
    return df.select("topic", "payload", "seq", "ts", *KEY, "kind", "suffix", *(c for c, _ in types.values()), "problem", "reason")


def read_rows(read: DataFrame, kind: str, suffix: str) -> DataFrame:
    """Of ``read_messages``, the typed rows of one message type that can be stored."""
    rows = read.where(_is(kind, suffix) & F.col("problem").isNull())
    return rows.select(*KEY, "seq", "ts", *(F.col(f"_{kind}_{suffix}.{f.name}") for f in _struct_of(PAYLOADS[kind, suffix])))


def parse_availability(messages: DataFrame, kind: str) -> DataFrame:
    """The state texts of one class; they are plain strings, not JSON."""
    df = split_topic(messages).where((F.col("kind") == kind) & (F.col("suffix") == "availability"))
    carried = ["ts"] if "ts" in messages.columns else []
    return df.select(*KEY, "topic", "seq", *carried, F.col("payload").alias("state"))


def topic(base: str | Column, kind: str, suffix: str) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return F.concat_ws("/", base, F.col("site_id"), F.lit(kind), F.col("device_name"), F.lit(suffix))


def _numbered(array: str, count: str, most: int, fields: list[str]) -> Column:
    """Array of structs with a 1-based ``id`` in front, cut to the device's number."""
    cut = F.slice(array, F.lit(1), N.clamp(F.col(count).cast("int"), 1, most))

    def item(x: Column, i: Column) -> Column:
        cols = [(i + 1).alias("id"), *(x[f].alias(f) for f in fields if f != "dc_energy")]
        if "dc_energy" in fields:
            cols.append(N.hybrid_null(N.scale_to_kilo(x["dc_energy"]), "hybrid").alias("dc_energy"))
        return F.struct(*cols)

    return F.transform(cut, item)


def _kilo(name: str) -> Column:
    return N.scale_to_kilo(name).alias(name)


def to_messages(readings: DataFrame, kind: str, base: str = "fleet") -> DataFrame:
    """(topic, payload, seq) of each quantised reading.

    ``to_json`` leaves NULL fields out, so a hybrid device's messages carry no
    DC counter.
    """
    millis = F.unix_millis("time").alias("time")
    if kind == "inverter":
        body = [
            millis, _kilo("ac_energy"), "ac_power_active", "ac_power_apparent", "ac_power_reactive", "ac_power_factor",
            _numbered("phases", "phase_count", 3, list(INVERTER_PHASE_FIELDS)).alias("phases"),
            "ac_frequency", "dc_power", "efficiency",
            _numbered("inputs", "input_count", 2, list(INVERTER_INPUT_FIELDS)).alias("inputs"),
        ]
    else:
        body = [
            millis,
            *map(_kilo, ("energy_active_import", "energy_active_export", "energy_apparent_import",
                         "energy_apparent_export", "energy_reactive_import", "energy_reactive_export")),
            "power_active", "power_apparent", "power_reactive", "power_factor", "frequency",
            "voltage_ph", "voltage_pp", "current",
            _numbered("phases", "phase_count", 3, list(METER_PHASE_FIELDS)).alias("phases"),
        ]
    return readings.select(topic(base, kind, "values").alias("topic"), F.to_json(F.struct(*body)).alias("payload"), "seq")


def device_messages(devices: DataFrame, kind: str, base: str = "fleet") -> DataFrame:
    """(topic, payload, seq) of each device descriptor."""
    names = [f.strip().split(" ")[0] for f in PAYLOADS[kind, "device"].split(",")]
    body = F.to_json(F.struct(*(F.col(n) for n in names if n in devices.columns)))
    return devices.select(topic(base, kind, "device").alias("topic"), body.alias("payload"), "seq")


def event_messages(events: DataFrame, base: str = "fleet") -> DataFrame:
    body = F.to_json(F.struct("active_code", "state", "events"))
    return events.select(topic(base, "inverter", "events").alias("topic"), body.alias("payload"), "seq")
