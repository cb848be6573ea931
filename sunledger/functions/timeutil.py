"""Wall-clock days, day bounds and epoch-aligned buckets.

``tz`` is a zone name or a string column, so sites in several zones can share
one job.
"""

from __future__ import annotations

import datetime as dt
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, functions as F


def zone(tz: str | Column) -> Column:
    return F.lit(tz) if isinstance(tz, str) else tz


def to_instant(civil: Column, tz: str | Column) -> Column:
    """Civil time (as a UTC-zoned timestamp) to the instant it names in ``tz``.

    Of a civil time that occurs twice when clocks go back, the second (standard
    time) is meant; Spark alone would take the first.  A skipped one moves
    forward by the gap.
    """
    first = F.to_utc_timestamp(civil, zone(tz))
    ahead = first + F.expr("INTERVAL '3' HOUR")
    offset_after = F.unix_micros(F.from_utc_timestamp(ahead, zone(tz))) - F.unix_micros(ahead)
    second = F.timestamp_micros(F.unix_micros(civil) - offset_after)
    return F.when(F.from_utc_timestamp(second, zone(tz)) == civil, second).otherwise(first)


def instant_sql(civil: str, tz: str) -> str:
    """:func:`to_instant` of two column names as SQL text."""
    first = f"to_utc_timestamp({civil}, {tz})"
    ahead = f"({first} + INTERVAL '3' HOUR)"
    second = f"timestamp_micros(unix_micros({civil}) - unix_micros(from_utc_timestamp({ahead}, {tz})) + unix_micros({ahead}))"
    return f"CASE WHEN from_utc_timestamp({second}, {tz}) = {civil} THEN {second} ELSE {first} END"


@lru_cache
def _midnight_repeats(tz: str) -> bool:
    """Whether some local midnight of 1970-2069 occurs twice in ``tz``."""
    info = ZoneInfo(tz)
    midnights = (dt.datetime(1970, 1, 1, tzinfo=info) + dt.timedelta(days=d) for d in range(36525))
    return any(m.utcoffset() > m.replace(fold=1).utcoffset() for m in midnights)


def local_day(time: Column | str, tz: str | Column) -> Column:
    """The wall-clock day an instant falls on (23, 24 or 25 hours long).

    Days begin at ``day_start``.  Where midnight itself can occur twice, the
    hour before the second one still belongs to the day before.
    """
    time = F.col(time) if isinstance(time, str) else time
    day = F.to_date(F.from_utc_timestamp(time, zone(tz)))
    if isinstance(tz, str) and not _midnight_repeats(tz):
        return day
    return F.when(time < day_start(day, tz), F.date_sub(day, 1)).otherwise(day)


def day_start(day: Column | str, tz: str | Column) -> Column:
    """The instant a local day begins."""
    day = F.col(day) if isinstance(day, str) else day
    return to_instant(day.cast("timestamp"), tz)


def day_end(day: Column | str, tz: str | Column) -> Column:
    return day_start(F.date_add(day, 1), tz)


def day_seconds(day: Column | str, tz: str | Column) -> Column:
    return F.unix_seconds(day_end(day, tz)) - F.unix_seconds(day_start(day, tz))


def day_bounds(df: DataFrame, tz: str | Column, day: str = "day") -> DataFrame:
    """Add ``day_start``, ``day_end`` and ``full_secs`` for each row's local day."""
    return df.withColumns({
        "day_start": day_start(day, tz),
        "day_end": day_end(day, tz),
        "full_secs": day_seconds(day, tz),
    })


def time_bucket(time: Column | str, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of ``seconds``."""
    epoch = F.unix_seconds(time)
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds)))


def span_seconds(first: Column | str, last: Column | str) -> Column:
    """Whole seconds from ``first`` to ``last``, rounded (a cast would truncate)."""
    return F.rint((F.unix_micros(last) - F.unix_micros(first)) / F.lit(1e6)).cast("long")


def in_local_days(df: DataFrame, start: dt.date, end: dt.date, tz: str, time: str = "time") -> DataFrame:
    """Rows of local days ``start`` .. ``end`` inclusive, as a plain range on ``time``.

    The bounds are folded to literals, so they reach the file scan; a test on
    ``local_day(time)`` would not.
    """
    first = day_start(F.lit(start), tz)
    last = day_end(F.lit(end), tz)
    return df.where((F.col(time) >= first) & (F.col(time) < last))


def day_spine(devices: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """One row per device and day, days without samples included."""
    days = F.sequence(F.lit(start), F.lit(end))
    return devices.withColumn("day", F.explode(days))


def day_spine_from_span(devices: DataFrame, spans: DataFrame) -> DataFrame:
    """A spine over each site's own ``first_day`` .. ``last_day`` range."""
    return (
        devices.join(spans.select("site_id", "first_day", "last_day"), "site_id")
        .withColumn("day", F.explode(F.sequence("first_day", "last_day")))
        .drop("first_day", "last_day")
    )
