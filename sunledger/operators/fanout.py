"""From one reading to sample, phase and input rows.

A *reading* carries Wh-family energies and arrays ``phases`` / ``inputs``; the
tables carry kWh-family doubles and floats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sunledger import KEY
from sunledger.functions import numeric as N

# Quantity class of every reading field.
INVERTER_FIELDS = {
    "ac_energy": "energy",
    "ac_power_active": "power",
    "ac_power_apparent": "power",
    "ac_power_reactive": "power",
    "ac_power_factor": "power_factor",
    "ac_frequency": "frequency",
    "dc_power": "power",
    "efficiency": "efficiency",
}
INVERTER_PHASE_FIELDS = {"ac_voltage": "voltage", "ac_current": "current"}
INVERTER_INPUT_FIELDS = {"dc_voltage": "voltage", "dc_current": "current", "dc_power": "power", "dc_energy": "energy"}
METER_FIELDS = {
    "energy_active_import": "energy",
    "energy_active_export": "energy",
    "energy_apparent_import": "energy",
    "energy_apparent_export": "energy",
    "energy_reactive_import": "energy",
    "energy_reactive_export": "energy",
    "power_active": "power",
    "power_apparent": "power",
    "power_reactive": "power",
    "power_factor": "power_factor",
    "frequency": "frequency",
    "voltage_ph": "voltage",
    "voltage_pp": "voltage",
    "current": "current",
}
METER_PHASE_FIELDS = {
    "power_active": "power",
    "power_apparent": "power",
    "power_reactive": "power",
    "power_factor": "power_factor",
    "voltage_ph": "voltage",
    "voltage_pp": "voltage",
    "current": "current",
}


def _quantise_items(array: str, fields: dict[str, str]) -> Column:
    return F.transform(array, lambda x: F.struct(*(N.quantise(x[f], q).alias(f) for f, q in fields.items())))


def quantise_inverter(readings: DataFrame) -> DataFrame:
    """Derive the efficiency, then bring every field to its output precision."""
    df = readings.withColumn("efficiency", N.efficiency("ac_power_active", "dc_power"))
    cols = {f: N.quantise(f, q) for f, q in INVERTER_FIELDS.items()}
    cols["phases"] = _quantise_items("phases", INVERTER_PHASE_FIELDS)
    cols["inputs"] = _quantise_items("inputs", INVERTER_INPUT_FIELDS)
    return df.withColumns(cols)


def quantise_meter(readings: DataFrame) -> DataFrame:
    cols = {f: N.quantise(f, q) for f, q in METER_FIELDS.items()}
    cols["phases"] = _quantise_items("phases", METER_PHASE_FIELDS)
    return readings.withColumns(cols)


def _stored(name: str, quantity: str, scale: bool = True) -> Column:
    if quantity == "energy":
        return (N.scale_to_kilo(name) if scale else F.col(name)).alias(name)
    return N.narrow(name).alias(name)


def _day() -> Column:
    return F.to_date("time").alias("day")


def inverter_rows(readings: DataFrame, scale: bool = True) -> DataFrame:
    """One sample row per reading; ``scale=False`` when energies are kWh already."""
    return readings.select(*KEY, "time", "seq", *(_stored(f, q, scale) for f, q in INVERTER_FIELDS.items()), _day())


def meter_rows(readings: DataFrame, scale: bool = True) -> DataFrame:
    return readings.select(*KEY, "time", "seq", *(_stored(f, q, scale) for f, q in METER_FIELDS.items()), _day())


def _explode(readings: DataFrame, array: str, count: str | None, most: int, id_name: str) -> DataFrame:
    items = F.col(array)
    if count is not None:
        items = F.slice(items, F.lit(1), N.clamp(F.col(count).cast("int"), 1, most))
    rows = readings.select("*", F.posexplode(items).alias("_pos", "_item"))
    # A message's item names its phase or input itself; only device readings go by position.
    own = "id" in readings.schema[array].dataType.elementType.fieldNames()
    number = F.coalesce(F.col("_item")["id"], F.col("_pos") + 1) if own else F.col("_pos") + 1
    return rows.withColumn(id_name, number.cast("short"))


def explode_phases(readings: DataFrame, kind: str, count: str | None = "phase_count") -> DataFrame:
    """Rows of the meaningful phases (1 to 3, the device's number)."""
    fields = INVERTER_PHASE_FIELDS if kind == "inverter" else METER_PHASE_FIELDS
    df = _explode(readings.select(*KEY, "time", "phases", *([count] if count else [])), "phases", count, 3, "phase_id")
    return df.select(*KEY, "time", "phase_id", *(N.narrow(F.col("_item")[f]).alias(f) for f in fields), _day())


def explode_inputs(readings: DataFrame, count: str | None = "input_count", hybrid: str | None = "hybrid",
                   scale: bool = True) -> DataFrame:
    """Rows of the meaningful DC inputs (1 or 2); no DC counter on hybrid devices."""
    extra = [c for c in (count, hybrid) if c]
    df = _explode(readings.select(*KEY, "time", "inputs", *extra), "inputs", count, 2, "input_id")
    energy = F.col("_item")["dc_energy"]
    energy = N.scale_to_kilo(energy) if scale else energy
    if hybrid:
        energy = N.hybrid_null(energy, hybrid)
    return df.select(
        *KEY, "time", "input_id",
        *(N.narrow(F.col("_item")[f]).alias(f) for f in ("dc_voltage", "dc_current", "dc_power")),
        energy.alias("dc_energy"), _day(),
    )
