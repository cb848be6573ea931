"""Explicit schemas of every table; nothing is inferred.

Energies are kWh-family doubles, powers, voltages and currents are floats,
instants are TIMESTAMP in a UTC session.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "short": T.ShortType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "bool": T.BooleanType(),
    "ts": T.TimestampType(),
    "date": T.DateType(),
    "strings": T.ArrayType(T.StringType()),
}


def _struct(spec: str, keyed: bool = True) -> T.StructType:
    """``"name:type name:type"`` to a StructType, key columns first."""
    prefix = "site_id:string device_name:string " if keyed else ""
    fields = (item.split(":") for item in (prefix + spec).split())
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


INVERTER_SAMPLES = _struct(
    "time:ts seq:long ac_energy:double ac_power_active:float ac_power_apparent:float "
    "ac_power_reactive:float ac_power_factor:float ac_frequency:float dc_power:float "
    "efficiency:float day:date"
)
INVERTER_PHASE_SAMPLES = _struct(
    "time:ts phase_id:short ac_voltage:float ac_current:float day:date"
)
INVERTER_INPUT_SAMPLES = _struct(
    "time:ts input_id:short dc_voltage:float dc_current:float dc_power:float "
    "dc_energy:double day:date"
)
METER_SAMPLES = _struct(
    "time:ts seq:long energy_active_import:double energy_active_export:double "
    "energy_apparent_import:double energy_apparent_export:double "
    "energy_reactive_import:double energy_reactive_export:double power_active:float "
    "power_apparent:float power_reactive:float power_factor:float frequency:float "
    "voltage_ph:float voltage_pp:float current:float day:date"
)
METER_PHASE_SAMPLES = _struct(
    "time:ts phase_id:short power_active:float power_apparent:float power_reactive:float "
    "power_factor:float voltage_ph:float voltage_pp:float current:float day:date"
)
INVERTER_DEVICE = _struct(
    "serial_number:string manufacturer:string model:string firmware_version:string "
    "data_manager:string register_model:string inverter_id:int slave_id:int hybrid:bool "
    "mppt_tracker:short phases:short power_rating:float first_seen:ts last_seen:ts"
)
METER_DEVICE = _struct(
    "serial_number:string manufacturer:string model:string firmware_version:string "
    "register_model:string meter_id:int slave_id:int phases:short first_seen:ts last_seen:ts"
)
POWER = _struct(
    "kind:string bucket:ts avg_power:double min_power:float max_power:float day:date"
)
INVERTER_DAILY = _struct(
    "day:date produced_kwh:double coverage:double complete:bool continuity:double "
    "continuous:bool sample_count:long first_ts:ts last_ts:ts first_kwh:double last_kwh:double"
)
METER_DAILY = _struct(
    "day:date imported_kwh:double exported_kwh:double coverage:double complete:bool "
    "continuity:double continuous:bool sample_count:long first_ts:ts last_ts:ts "
    "imported_kwh_first:double imported_kwh_last:double exported_kwh_first:double "
    "exported_kwh_last:double"
)
REGISTRY = _struct("kind:string location:string is_primary:bool updated_at:ts")
SITE = _struct(
    "site_id:string latitude:double longitude:double horizon_deg:double updated_at:ts", keyed=False
)
SITE_ENERGY = _struct(
    "site_id:string day:date production_kwh:double consumption_kwh:double "
    "self_consumption_kwh:double from_grid_kwh:double to_grid_kwh:double complete:bool "
    "continuous:bool", keyed=False
)
MESSAGES = _struct("topic:string payload:string seq:long ts:ts", keyed=False)

INVERTER_EVENTS = _struct("seq:long ts:ts active_code:int state:string events:strings day:date")
AVAILABILITY = _struct("kind:string seq:long ts:ts state:string day:date")

MESSAGE_REJECTS = _struct("topic:string payload:string seq:long reason:string day:date", keyed=False)



def _buckets(*counters: str) -> T.StructType:
    """Kept day buckets; ``day`` is the UTC day of the bucket."""
    each = " ".join(f"{c}_n:long {c}_t0:ts {c}_t1:ts {c}_v0:double {c}_v1:double" for c in counters)
    return _struct(f"bucket:ts n:long t0:ts t1:ts power_n:long power_sum:double power_min:float power_max:float {each} day:date")


# Tables of a store folder, all but the dimensions partitioned by ``day``.
TABLES = {
    "inverter_samples": INVERTER_SAMPLES,
    "inverter_phase_samples": INVERTER_PHASE_SAMPLES,
    "inverter_input_samples": INVERTER_INPUT_SAMPLES,
    "meter_samples": METER_SAMPLES,
    "meter_phase_samples": METER_PHASE_SAMPLES,
    # What each batch added to the 30-second buckets; several rows of a bucket are merged when read.
    "inverter_buckets": _buckets("ac_energy"),
    "meter_buckets": _buckets("energy_active_import", "energy_active_export"),
    "power_30sec": POWER,
    "power_5min": POWER,
    "inverter_daily": INVERTER_DAILY,
    "meter_daily": METER_DAILY,
    "site_energy": SITE_ENERGY,
    "inverter_device": INVERTER_DEVICE,
    "meter_device": METER_DEVICE,
    "device_registry": REGISTRY,
    "site": SITE,
    "inverter_events": INVERTER_EVENTS,
    "availability": AVAILABILITY,
    "message_rejects": MESSAGE_REJECTS,
    # Five-minute buckets that got samples after they had been refreshed, in the day of arrival.
    "power_late": _struct("kind:string bucket:ts day:date"),
    # Up to where each power table is refreshed.
    "power_progress": _struct("name:string until:ts", keyed=False),
    # The last accepted snapshot of each device, which the next one is compared with.
    "last_events": T.StructType([f for f in INVERTER_EVENTS if f.name != "day"]),
    "last_availability": T.StructType([f for f in AVAILABILITY if f.name != "day"]),
}
# Tables without days: written as numbered snapshots.
DIMENSIONS = ["inverter_device", "meter_device", "device_registry", "site", "last_events", "last_availability", "power_progress"]

# JSON payloads, keyed by (kind, suffix).
_PHASE_INVERTER = "array<struct<id:int,ac_voltage:double,ac_current:double>>"
_INPUTS = (
    "array<struct<id:int,dc_voltage:double,dc_current:double,dc_power:double,dc_energy:double>>"
)
_PHASE_METER = (
    "array<struct<id:int,power_active:double,power_apparent:double,power_reactive:double,"
    "power_factor:double,voltage_ph:double,voltage_pp:double,current:double>>"
)
PAYLOADS = {
    ("inverter", "values"): (
        "time bigint, ac_energy double, ac_power_active double, ac_power_apparent double, "
        "ac_power_reactive double, ac_power_factor double, "
        f"phases {_PHASE_INVERTER}, ac_frequency double, dc_power double, efficiency double, "
        f"inputs {_INPUTS}"
    ),
    ("inverter", "events"): "active_code int, state string, events array<string>",
    ("inverter", "device"): (
        "manufacturer string, model string, serial_number string, firmware_version string, "
        "data_manager string, register_model string, hybrid boolean, inverter_id int, "
        "slave_id int, phases int, mppt_tracker int, power_rating double"
    ),
    ("meter", "values"): (
        "time bigint, energy_active_import double, energy_active_export double, "
        "energy_apparent_import double, energy_apparent_export double, "
        "energy_reactive_import double, energy_reactive_export double, power_active double, "
        "power_apparent double, power_reactive double, power_factor double, frequency double, "
        f"voltage_ph double, voltage_pp double, current double, phases {_PHASE_METER}"
    ),
    ("meter", "device"): (
        "manufacturer string, model string, serial_number string, firmware_version string, "
        "data_manager string, register_model string, slave_id int, meter_id int, phases int"
    ),
}
