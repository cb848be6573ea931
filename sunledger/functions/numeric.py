"""Scaling, quantising and electrical derivations as codegen'd column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Decimals kept per class of quantity (energy is still in Wh here).
DECIMALS = {
    "energy": 0,
    "voltage": 1,
    "current": 3,
    "power": 2,
    "power_factor": 2,
    "frequency": 2,
    "efficiency": 2,
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scale_to_kilo(c: Column | str) -> Column:
    """Wh to kWh; a division, so whole Wh give the nearest 3-decimal kWh."""
    return _col(c) / F.lit(1000.0)


def round_half_away(c: Column | str, places: int) -> Column:
    """Round half away from zero at ``places`` decimals of the scaled double.

    Spark's ``round`` works on the decimal text of a double: it rounds 1.005 up
    where the scaled double is just below the tie, and it is slow.  ``rint`` of
    the scaled magnitude, moved up on an exact tie, keeps NaN and infinities as
    they are.
    """
    factor = F.lit(10.0 ** places)
    value = _col(c).cast("double")
    scaled = F.abs(value) * factor
    even = F.rint(scaled)
    up = F.when(scaled - even == F.lit(0.5), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.signum(value) * (even + up) / factor


def quantise(c: Column | str, quantity: str) -> Column:
    """Round at the decimals kept for this kind of quantity."""
    return round_half_away(c, DECIMALS[quantity])


def narrow(c: Column | str) -> Column:
    """32-bit storage of powers, voltages and currents."""
    return _col(c).cast("float")


def efficiency(ac_power: Column | str, dc_power: Column | str) -> Column:
    """AC over DC power in percent, 0 without DC power."""
    dc = _col(dc_power)
    return F.when(F.abs(dc) > 1e-12, _col(ac_power) / dc * 100.0).otherwise(F.lit(0.0))


def hybrid_null(dc_energy: Column | str, hybrid: Column | str) -> Column:
    """A hybrid device exposes no DC counter: NULL instead of a misleading zero."""
    return F.when(~_col(hybrid), _col(dc_energy))


def reactive_energy(apparent: Column | str, active: Column | str, reactive_power: Column | str) -> Column:
    """Reactive from apparent and active energy, signed by the reactive power; NaN if |active| > apparent."""
    s, p = _col(apparent), _col(active)
    radicand = s * s - p * p
    root = F.when(radicand < 0, F.lit(float("nan"))).otherwise(F.sqrt(radicand))
    return F.when(_col(reactive_power) >= 0, root).otherwise(-root)


def apparent_energy(active: Column | str, reactive: Column | str) -> Column:
    return F.hypot(_col(active), _col(reactive))


def current_total(phase_currents: Column, measured: Column | str, register_map: Column | str) -> Column:
    """Sum of the phase currents where the map has no total, else the measured total."""
    summed = F.aggregate(phase_currents, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(_col(register_map) == "proprietary", summed).otherwise(_col(measured))


def positive_or_null(c: Column | str) -> Column:
    """Unset numeric identity (zero or negative) becomes NULL."""
    return F.when(_col(c) > 0, _col(c))


def text_or_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """A fraction, NULL when the whole is zero."""
    return F.try_divide(_col(part), F.nullif(_col(whole), F.lit(0.0)))


def clamp(c: Column | str, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(c)))
