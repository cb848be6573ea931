"""Value constraints as rules that split rows into valid and rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Allowed enumerations, ranges and the device name form.
REGISTER_MODELS = ["int+sf", "float"]
KINDS = ["inverter", "meter"]
LOCATIONS = ["feed-in", "consumption"]
NAME_PATTERN = "^[A-Za-z0-9_-]+$"
NAME_MAX = 32
RESERVED_NAMES = ["meter", "inverter"]


def rule_sets() -> dict[str, dict[str, Column]]:
    """Rules per table.  A rule that evaluates to NULL passes, like a SQL CHECK."""
    c = F.col
    slave = c("slave_id").between(1, 247)
    device = {
        "device_phases": c("phases").between(1, 3),
        "device_slave_id": slave,
        "device_register": c("register_model").isin(REGISTER_MODELS),
    }
    return {
        "inverter_device": {**device, "device_mppt": c("mppt_tracker").between(1, 2)},
        "meter_device": device,
        "phase_samples": {"phase_id": c("phase_id").between(1, 3)},
        "input_samples": {"input_id": c("input_id").between(1, 2)},
        "device_registry": {
            "registry_kind": c("kind").isin(KINDS),
            "registry_location": c("location").isin(LOCATIONS),
        },
        "site": {
            "site_latitude": c("latitude").between(-90, 90),
            "site_longitude": c("longitude").between(-180, 180),
            "site_horizon": c("horizon_deg").between(-18, 20),
        },
    }


def constraint_split(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violations``: the names of the rules each row breaks (empty when valid)."""
    return df.withColumn(
        "violations", F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items()))))


def valid_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return constraint_split(df, rules).where(F.size("violations") == 0).drop("violations")


def rejected_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return constraint_split(df, rules).where(F.size("violations") > 0)


def registry_validate(registry: DataFrame) -> DataFrame:
    """Roster checks: name form, reserved and duplicate names, one located primary per site."""
    same_name = registry.groupBy("site_id", "device_name").agg(F.count(F.lit(1)).alias("n_same"))
    primaries = registry.groupBy("site_id").agg(F.count_if("is_primary").alias("n_primary"))
    name = F.col("device_name")
    df = registry.join(same_name, ["site_id", "device_name"]).join(primaries, "site_id")
    return constraint_split(df, {
        "name_empty": name != "",
        "name_too_long": F.length(name) <= NAME_MAX,
        "name_form": (name == "") | name.rlike(NAME_PATTERN),
        "name_reserved": ~name.isin(RESERVED_NAMES),
        "name_duplicate": F.col("n_same") == 1,
        "several_primaries": ~F.col("is_primary") | (F.col("n_primary") <= 1),
        "primary_without_location": ~F.col("is_primary") | F.col("location").isNotNull(),
    }).drop("n_same", "n_primary")
