"""Daylight length, sunrise and sunset from a site's coordinates.

The model is written once, as named SQL expressions: the calendar adds them to a
DataFrame, the SQL table function nests them in a query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sunledger.functions.timeutil import instant_sql, zone

# Fixed values of the model: Cooper's declination and the equation of time in minutes.
TILT_DEG = 23.45
DECLINATION_SHIFT, DECLINATION_YEAR = 284, 365
EOT_SHIFT, EOT_YEAR = 81, 364
EOT_SIN_2B, EOT_COS_B, EOT_SIN_B = 9.87, 7.53, 1.5
DEFAULT_HORIZON_DEG = -0.833
FULL_DAY = 86400

# Inputs: day, latitude, longitude, horizon_deg and the zone name _tz.  Each
# level only uses columns of the levels before it.
LEVELS: list[dict[str, str]] = [
    {
        "_noon": "CAST(day AS TIMESTAMP) + INTERVAL '12' HOUR",
        "_declination": f"{math.radians(TILT_DEG)!r}D * sin({2 * math.pi / DECLINATION_YEAR!r}D * (dayofyear(day) + {DECLINATION_SHIFT}))",
        "_angle": f"{2 * math.pi / EOT_YEAR!r}D * (dayofyear(day) - {EOT_SHIFT})",
    },
    {
        "_zone_h": f"(unix_seconds(_noon) - unix_seconds({instant_sql('_noon', '_tz')})) / 3600D",
        "_sundial_h": f"({EOT_SIN_2B}D * sin(2 * _angle) - {EOT_COS_B}D * cos(_angle) - {EOT_SIN_B}D * sin(_angle)) / 60D",
        "_cosine": f"(sin(radians(coalesce(horizon_deg, {DEFAULT_HORIZON_DEG}D))) - sin(radians(latitude)) * sin(_declination))"
                   " / (cos(radians(latitude)) * cos(_declination))",
    },
    {"_half_h": "CASE WHEN abs(_cosine) < 1 THEN degrees(acos(_cosine)) / 15D END"},
    {
        # Never up or never down: no crossing, but a length.
        "seconds": f"CAST(CASE WHEN _cosine >= 1 THEN 0 WHEN _cosine <= -1 THEN {FULL_DAY} ELSE rint(7200D * _half_h) END AS INT)",
        "_rise": "timestamp_seconds(unix_seconds(_noon) + CAST(rint((_zone_h - longitude / 15D - _sundial_h - _half_h) * 3600D) AS BIGINT))",
    },
    {"sunrise": instant_sql("_rise", "_tz")},
    {
        "sunset": "timestamp_seconds(unix_seconds(sunrise) + seconds)",
        "daylight": "make_dt_interval(0, 0, 0, CAST(seconds AS DECIMAL(18, 6)))",
    },
]


def daylight_calendar(spine: DataFrame, tz: str | Column) -> DataFrame:
    """Daylight per (site, day).

    ``spine`` has ``site_id, day, latitude, longitude, horizon_deg``.  Added:
    ``seconds`` (0 and 86400 at the poles), ``daylight`` as an interval, and the
    ``sunrise``/``sunset`` instants, NULL when the sun does not cross the
    horizon.  A site without coordinates has NULL everywhere.
    """
    df = spine.withColumn("_tz", zone(tz))
    for level in LEVELS:
        df = df.withColumns({name: F.expr(text) for name, text in level.items()})
    return df.drop("_tz", *(name for level in LEVELS for name in level if name.startswith("_")))


def site_days(sites: DataFrame, days: DataFrame) -> DataFrame:
    """Attach coordinates to a (site_id, day) spine; a site with only one of them has none."""
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    placed = sites.select("site_id", *(F.when(both, F.col(c)).alias(c) for c in ("latitude", "longitude")), "horizon_deg")
    return days.join(placed, "site_id", "left")


def register_solar_daylight(spark: SparkSession) -> None:
    """``solar_daylight(lat, lon, day [, tz [, horizon_deg]])`` as a SQL table function."""
    query = "SELECT lat_deg AS latitude, lon_deg AS longitude, horizon AS horizon_deg, for_day AS day, tz AS _tz"
    for level in LEVELS:
        query = f"SELECT *, {', '.join(f'{text} AS {name}' for name, text in level.items())} FROM ({query})"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION solar_daylight(
          lat_deg DOUBLE, lon_deg DOUBLE, for_day DATE, tz STRING DEFAULT current_timezone(),
          horizon DOUBLE DEFAULT {DEFAULT_HORIZON_DEG}D)
        RETURNS TABLE (daylight INTERVAL DAY TO SECOND, seconds INT, sunrise TIMESTAMP, sunset TIMESTAMP)
        RETURN SELECT daylight, seconds, sunrise, sunset FROM ({query})""")
