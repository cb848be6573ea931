"""Device descriptors, roster and site settings as keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sunledger import KEY
from sunledger.functions import numeric as N
from sunledger.functions.solar import DEFAULT_HORIZON_DEG
from sunledger.operators.ordered import latest

DEVICE_KEY = [*KEY, "serial_number"]


def meter_identity_nulls(devices: DataFrame) -> DataFrame:
    """Identity a meter does not have is NULL rather than empty or zero."""
    return devices.withColumns({
        "register_model": N.text_or_null("register_model"),
        "meter_id": N.positive_or_null("meter_id"),
        "slave_id": N.positive_or_null("slave_id"),
    })


def device_upsert(seen: DataFrame, current: DataFrame | None = None, at: str = "ts") -> DataFrame:
    """Latest descriptor per serial with its first and last sighting.

    A replaced device has a new serial and so adds a row.  ``current`` is the
    stored table: its ``first_seen`` survives, its fields yield to newer ones.
    """
    fields = [c for c in seen.columns if c not in (*DEVICE_KEY, at)]
    rows = seen.select(*DEVICE_KEY, *fields, F.col(at).alias("first_seen"), F.col(at).alias("last_seen"))
    if current is not None:
        rows = rows.unionByName(current.select(rows.columns))
    seen_between = rows.groupBy(*DEVICE_KEY).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    newest = latest(rows.select(*DEVICE_KEY, *fields, "last_seen"), DEVICE_KEY, "last_seen").drop("last_seen")
    return newest.join(seen_between, DEVICE_KEY).select(*DEVICE_KEY, *fields, "first_seen", "last_seen")


def registry_anti(current: DataFrame, configured: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Roster rows to remove: of a configured site, but no longer configured."""
    sites = (configured if sites is None else sites).select("site_id").distinct()
    return current.join(sites, "site_id", "left_semi").join(configured.select(*KEY), KEY, "left_anti")


def sync_registry(current: DataFrame, configured: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """The configured roster replaces a site's rows; other sites keep theirs.

    ``sites``: the configured sites, by default those with a device; one that is configured without devices is emptied.
    """
    sites = (configured if sites is None else sites).select("site_id").distinct()
    cols = [*KEY, "kind", "location", "is_primary", *(["updated_at"] if "updated_at" in configured.columns else [])]
    return configured.select(cols).unionByName(current.join(sites, "site_id", "left_anti").select(cols))


def site_upsert(current: DataFrame, configured: DataFrame, at: Column | None = None) -> DataFrame:
    """Replace the coordinates of configured sites; NULL where none are set.  With ``at`` also their ``updated_at``."""
    cols = ["site_id", "latitude", "longitude", "horizon_deg"] + (["updated_at"] if at is not None else [])
    incoming = configured.select(
        "site_id", "latitude", "longitude",
        F.coalesce("horizon_deg", F.lit(DEFAULT_HORIZON_DEG)).alias("horizon_deg"),
        *([at.alias("updated_at")] if at is not None else []))
    kept = current.join(incoming.select("site_id"), "site_id", "left_anti")
    return incoming.unionByName(kept.select(cols))
