"""Raw meter telegrams to typed measurements.

A telegram is parsed inside its own row with string functions: no explode and no
regrouping, so nothing is shuffled however many telegrams there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Line forms, measured codes and identity of this meter type.
LINE_PATTERN = r"[0-9]-0:[0-9]+.[0-9]+.[0-9]+\*255\([^)\n]+\)"
VERSION_PATTERN = r"/[A-Za-z0-9]+_[A-Za-z0-9]+$"
NUMBER_PATTERN = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
CODE_ENERGY = "1-0:1.8.0*255"
CODE_POWER = "1-0:16.7.0*255"
CODES_PHASE_POWER = ["1-0:36.7.0*255", "1-0:56.7.0*255", "1-0:76.7.0*255"]
CODES_PHASE_VOLTAGE = ["1-0:32.7.0*255", "1-0:52.7.0*255", "1-0:72.7.0*255"]
CODE_SERIAL = "1-0:96.1.0*255"
MANUFACTURER = "EasyMeter"
MODEL = "DD3-BZ06-ETA-ODZ1"
PHASES = 3

# Lines of a text that are neither empty, an end mark nor of their form; the last version.
BAD_VERSION_LINE = rf"(?md)^(?=/)(?!{VERSION_PATTERN})"
BAD_VALUE_LINE = rf"(?md)^(?!$|[/!]|{LINE_PATTERN})"
LAST_VERSION = r"(?sd)^.*\n/[A-Za-z0-9]+_([A-Za-z0-9]+)"

INCOMPLETE = "incomplete telegram"
TOO_LONG = "telegram too long"
BAD_VERSION = "malformed version line"
BAD_LINE = "malformed line"
BAD_NUMBER = "malformed number"


def _number(text: Column) -> Column:
    """The number before the unit; text after its digits is ignored."""
    text = F.substring_index(text, "*", 1)
    return F.coalesce(text.try_cast("double"),
                      F.nullif(F.regexp_extract(text, NUMBER_PATTERN, 1), F.lit("")).try_cast("double"))


def _value(code: Column) -> Column:
    """Raw value of the last line with this code, NULL when missing: plain substring search."""
    start = F.concat(F.lit("\n"), code, F.lit("("))
    after = F.call_function("substring_index", F.col("_text"), start, F.lit(-1))
    return F.when(F.contains(F.col("_text"), start), F.substring_index(after, ")", 1))


def _once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are evaluated once per row.

    A plain projection would be inlined into every later use, a filter's above
    all; the row of a one-element ``inline`` is not.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in cols.items())))))


def parse_telegrams(telegrams: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Add identity, ``energy`` (Wh), ``power``, ``phase_power``, ``phase_voltage`` and ``reject_reason``.

    Unknown codes are ignored and missing ones read as 0; one malformed line
    makes the whole telegram a reject.  ``max_bytes`` also rejects longer ones.
    """
    # Array functions over the codes keep the generated code small enough to be compiled.
    codes = F.array(*map(F.lit, [CODE_ENERGY, CODE_POWER, *CODES_PHASE_POWER, *CODES_PHASE_VOLTAGE]))
    # Every line starts after a newline, the first one too.
    df = _once(
        telegrams,
        _text=F.concat(F.lit("\n"), F.replace("telegram", F.lit("\r"), F.lit(""))),
        _framing=F.when(F.substring("telegram", -3, 1) != "!", INCOMPLETE)
        .when(F.octet_length("telegram") > F.lit(max_bytes), TOO_LONG))
    df = _once(
        df,
        _lines=F.when(F.col("_text").rlike(BAD_VERSION_LINE), BAD_VERSION)
        .when(F.col("_text").rlike(BAD_VALUE_LINE), BAD_LINE),
        firmware_version=F.regexp_extract("_text", LAST_VERSION, 1),
        serial_number=F.coalesce(_value(F.lit(CODE_SERIAL)), F.lit("")),
        _raw=F.transform(codes, _value))
    df = _once(
        df,
        _unreadable=F.exists("_raw", lambda r: r.isNotNull() & _number(r).isNull()),
        _num=F.transform("_raw", lambda r: F.coalesce(_number(r), F.lit(0.0))))
    return df.withColumns({
        "reject_reason": F.coalesce("_framing", "_lines", F.when(F.col("_unreadable"), BAD_NUMBER)),
        "energy": F.col("_num")[0] * 1000.0,
        "power": F.col("_num")[1],
        "phase_power": F.slice("_num", 3, 3),
        "phase_voltage": F.slice("_num", 6, 3),
    }).drop("_text", "_framing", "_lines", "_raw", "_num", "_unreadable")


def telegram_readings(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("telegram", "reject_reason")


def telegram_rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull()).select(
        *[c for c in ("site_id", "device_name", "received_at", "seq") if c in parsed.columns], "telegram", "reject_reason")


def telegram_devices(readings: DataFrame) -> DataFrame:
    """The fixed identity of this meter type with the parsed serial and firmware."""
    return readings.withColumns({
        "manufacturer": F.lit(MANUFACTURER), "model": F.lit(MODEL), "phases": F.lit(PHASES).cast("short")})
