"""The SQL side: stored tables as views, and daylight as a table function.

After :func:`register`, reports run as plain SQL in the session, for example::

    SELECT site_id, kind, date_trunc('hour', bucket) AS hour, sum(avg_power * 30) / 3600e3 AS kwh
    FROM power_30sec WHERE day BETWEEN DATE'2024-03-01' AND DATE'2024-03-07'
    GROUP BY ALL HAVING count(DISTINCT device_name) > 1
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from sunledger.functions.solar import register_solar_daylight
from sunledger.schemas import TABLES
from sunledger.sources.store import exists
from sunledger.sources.tables import read_table, table_path


def register(spark: SparkSession, store: str) -> list[str]:
    """Functions, and a temporary view per table of the store that exists; returns their names."""
    register_solar_daylight(spark)
    names = [t for t in TABLES if exists(spark, table_path(store, t))]
    for name in names:
        read_table(spark, store, name).createOrReplaceTempView(name)
    return names
