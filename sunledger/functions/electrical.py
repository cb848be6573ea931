"""Quantities a power-only meter does not measure, from an assumed grid state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Grid:
    """Assumed power factor, frequency and direction of reactive power."""

    power_factor: float = 0.95
    frequency: float = 50.0
    leading: bool = False


def _derived(active: Column, voltage: Column, next_voltage: Column, pf: Column, lead: Column) -> dict[str, Column]:
    # tan/sin of acos|pf| are the same for every row with one grid; Catalyst folds them when pf is a literal.
    power = active * F.when(pf > 0, 1.0).otherwise(-1.0)
    return {
        "power_active": power,
        "power_apparent": F.abs(power / pf),
        "power_reactive": F.when(lead, -1.0).otherwise(1.0) * F.tan(F.acos(F.abs(pf))) * power,
        "power_factor": pf,
        "voltage_ph": voltage,
        "voltage_pp": F.sqrt(voltage * voltage + next_voltage * next_voltage + voltage * next_voltage),
        # No voltage means no current figure: NULL instead of an infinity.
        "current": F.abs(F.try_divide(power, voltage * pf)),
    }


def grid_assumption_derive(df: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """A full meter reading (Wh, W, V, A) from measured power, energy and voltages.

    Input: ``energy`` (Wh), ``power`` (W) and arrays ``phase_power``,
    ``phase_voltage`` of three.  Output: the meter reading fields and ``phases``.
    """
    pf, lead = F.lit(grid.power_factor), F.lit(grid.leading)
    phases = []
    for i in range(3):
        voltage, after = F.col("phase_voltage")[i], F.col("phase_voltage")[(i + 1) % 3]
        phases.append(F.struct(*(c.alias(n) for n, c in _derived(F.col("phase_power")[i], voltage, after, pf, lead).items())))
    df = df.withColumn("phases", F.array(*phases))
    p = [F.col("phases")[i] for i in range(3)]
    total = _derived(F.col("power"), F.lit(0.0), F.lit(0.0), pf, lead)
    apparent = F.abs(F.col("energy") / pf)
    reactive = F.sin(F.acos(F.abs(pf))) * apparent
    zero = F.lit(0.0)
    return df.withColumns({
        "energy_active_import": F.when(pf > 0, F.col("energy")).otherwise(zero),
        "energy_active_export": F.when(pf < 0, F.col("energy")).otherwise(zero),
        "energy_apparent_import": F.when(lead, zero).otherwise(apparent),
        "energy_apparent_export": F.when(lead, apparent).otherwise(zero),
        "energy_reactive_import": F.when(lead, zero).otherwise(reactive),
        "energy_reactive_export": F.when(lead, reactive).otherwise(zero),
        "power_active": total["power_active"],
        "power_apparent": total["power_apparent"],
        "power_reactive": total["power_reactive"],
        "power_factor": pf,
        "frequency": F.lit(grid.frequency),
        "voltage_ph": (p[0]["voltage_ph"] + p[1]["voltage_ph"] + p[2]["voltage_ph"]) / 3.0,
        "voltage_pp": (p[0]["voltage_pp"] + p[1]["voltage_pp"] + p[2]["voltage_pp"]) / 3.0,
        "current": p[0]["current"] + p[1]["current"] + p[2]["current"],
    })
