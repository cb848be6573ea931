"""The registered queries: every operator over the whole of the given tables.

Results use plain types (text instants and days, doubles, longs), so any SQL
engine's rows compare with them value for value.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sunledger import KEY
from sunledger.functions import electrical, numeric as N, solar, timeutil as TU
from sunledger.operators import counters, daily, devices, fanout, ordered, power, reports, site, validation
from sunledger.plans import rollup
from sunledger.schemas import PAYLOADS
from sunledger.session import apply_settings, work_dir
from sunledger.sources import driver_tables as A, messages as M, store as S, tables, telegrams as TG
from sunledger.streaming import device_state as SD, ingest as SI, live as SL, power as SP

TZ = A.TZ
LOOSE = rollup.Thresholds(inverter_coverage_min=0.95, meter_coverage_min=0.95, continuity_min=0.75, bucket_seconds=3600)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def portable(df: DataFrame) -> DataFrame:
    """Plain result types."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.ShortType, T.IntegerType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark)
            return portable(fn(spark, sf_dir))

        QUERIES[name] = run
        return run

    return register


def _spine(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    """Every device on every local day between its site's first and last reading."""
    if seen is None:
        spans = reports.data_span(A.readings(spark, sf_dir), TZ, ["site_id"])
    else:
        spans = seen.groupBy("site_id").agg(TU.local_day(F.min("t0"), TZ).alias("first_day"), TU.local_day(F.max("t1"), TZ).alias("last_day"))
    return TU.day_spine_from_span(A.registry(spark, sf_dir, seen).select(*KEY, "kind"), spans)


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A small frame that several branches of a plan use, made once."""
    at = work_dir(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _inverter_days(spark: SparkSession, sf_dir: str, limits=rollup.Thresholds()) -> DataFrame:
    return rollup.compute_inverter_energy(
        A.inverter_samples(spark, sf_dir), _spine(spark, sf_dir).where("kind = 'inverter'"), A.sites(spark, sf_dir), TZ, limits)


def _meter_days(spark: SparkSession, sf_dir: str, limits=rollup.Thresholds()) -> DataFrame:
    return rollup.compute_meter_energy(
        A.meter_samples(spark, sf_dir), _spine(spark, sf_dir).where("kind = 'meter'"), TZ, limits)


@query("meter_daily")
def meter_daily(spark, sf_dir):
    return _meter_days(spark, sf_dir)


@query("meter_daily_hourly")
def meter_daily_hourly(spark, sf_dir):
    return _meter_days(spark, sf_dir, LOOSE)


@query("inverter_daily")
def inverter_daily(spark, sf_dir):
    return _inverter_days(spark, sf_dir)


@query("inverter_daily_hourly")
def inverter_daily_hourly(spark, sf_dir):
    return _inverter_days(spark, sf_dir, LOOSE)


def _rollup(spark: SparkSession, sf_dir: str, limits=rollup.Thresholds()) -> DataFrame:
    seen = _written(spark, A.seen_devices(spark, sf_dir), "devices")
    return rollup.compute_site_rollup(
        A.inverter_samples(spark, sf_dir), A.meter_samples(spark, sf_dir), A.registry(spark, sf_dir, seen),
        A.sites(spark, sf_dir, seen), _written(spark, _spine(spark, sf_dir, seen), "spine"), TZ, limits, work_dir(spark, "rollup"))["site_energy"]


SITE_FIGURES = ["production_kwh", "consumption_kwh", "self_consumption_kwh", "from_grid_kwh", "to_grid_kwh"]


def _rounded(df: DataFrame, cols: list[str], places: int = 9) -> DataFrame:
    """Sums of fractions depend on their order in the last bits."""
    return df.withColumns({c: N.round_half_away(c, places) for c in cols})


@query("site_rollup")
def site_rollup(spark, sf_dir):
    return _rounded(_rollup(spark, sf_dir), SITE_FIGURES)


@query("site_rollup_hourly")
def site_rollup_hourly(spark, sf_dir):
    return _rounded(_rollup(spark, sf_dir, LOOSE), SITE_FIGURES)


# --- scans, sources, sinks -------------------------------------------------

def _store(spark: SparkSession, sf_dir: str) -> str:
    store = work_dir(spark, "store")
    A.write_store(spark, sf_dir, store)
    return store


def _messages(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    if kind == "inverter":
        return M.to_messages(fanout.quantise_inverter(A.inverter_readings(spark, sf_dir)), kind)
    return M.to_messages(fanout.quantise_meter(A.meter_readings(spark, sf_dir)), kind)


@query("sample_scan")
def sample_scan(spark, sf_dir):
    store = _store(spark, sf_dir)
    df = tables.read_samples(spark, store, "meter_samples", dt.datetime(2024, 1, 5, 6), dt.datetime(2024, 1, 12, 18, 30))
    return df.select(*KEY, "time", "seq", "energy_active_import", "power_active")


@query("dim_scan")
def dim_scan(spark, sf_dir):
    registry, sites = tables.read_dims(spark, _store(spark, sf_dir))
    return registry.join(sites, "site_id").select(*KEY, "kind", "location", "is_primary", "latitude", "longitude", "horizon_deg")


@query("telemetry_json_scan")
def telemetry_json_scan(spark, sf_dir):
    """Inverter messages, every 97th cut off half-way."""
    cut = F.when(F.col("seq") % 97 == 0, F.substring("payload", 1, 40)).otherwise(F.col("payload"))
    parsed = M.parse_messages(_messages(spark, sf_dir, "inverter").withColumn("payload", cut), "inverter")
    return parsed.select(
        *KEY, "seq", "malformed", "time", "ac_energy", "ac_power_active", "efficiency",
        F.size("phases").alias("n_phases"), F.element_at("inputs", 1)["dc_energy"].alias("dc_energy_1"))


@query("telemetry_json_scan_meter")
def telemetry_json_scan_meter(spark, sf_dir):
    parsed = M.parse_messages(_messages(spark, sf_dir, "meter"), "meter")
    return parsed.select(
        *KEY, "seq", "malformed", "time", "energy_active_import", "energy_active_export", "power_active", "current",
        F.size("phases").alias("n_phases"), F.element_at("phases", 1)["power_active"].alias("power_active_1"))


@query("telemetry_json_sink")
def telemetry_json_sink(spark, sf_dir):
    df = _messages(spark, sf_dir, "inverter")

    def field(path: str):
        return F.get_json_object("payload", path)

    return df.select(
        "topic", "seq", field("$.time").cast("long").alias("time_ms"), field("$.ac_energy").cast("double").alias("ac_energy"),
        field("$.phases[0].ac_voltage").cast("double").alias("ac_voltage_1"),
        field("$.inputs[1].dc_energy").cast("double").alias("dc_energy_2"),
        (F.instr("payload", "dc_energy") > 0).alias("has_dc_energy"), F.size(F.json_object_keys("payload")).alias("n_fields"))


@query("sample_fanout_samples")
def sample_fanout_samples(spark, sf_dir):
    return fanout.inverter_rows(fanout.quantise_inverter(A.inverter_readings(spark, sf_dir))).drop("day")


@query("sample_fanout_phases")
def sample_fanout_phases(spark, sf_dir):
    return fanout.explode_phases(fanout.quantise_inverter(A.inverter_readings(spark, sf_dir)), "inverter").drop("day")


@query("sample_fanout_inputs")
def sample_fanout_inputs(spark, sf_dir):
    return fanout.explode_inputs(fanout.quantise_inverter(A.inverter_readings(spark, sf_dir))).drop("day")


@query("sample_fanout_meter_samples")
def sample_fanout_meter_samples(spark, sf_dir):
    return fanout.meter_rows(fanout.quantise_meter(A.meter_readings(spark, sf_dir))).drop("day")


@query("sample_fanout_meter_phases")
def sample_fanout_meter_phases(spark, sf_dir):
    return fanout.explode_phases(fanout.quantise_meter(A.meter_readings(spark, sf_dir)), "meter").drop("day")


@query("device_upsert")
def device_upsert(spark, sf_dir):
    """The second half of the sightings on top of a table made from the first."""
    seen = A.device_sightings(spark, sf_dir).drop("seq")
    half = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return devices.device_upsert(seen.where(~half), devices.device_upsert(seen.where(half)))


@query("registry_sync")
def registry_sync(spark, sf_dir):
    return devices.sync_registry(A.fleet_roster(spark, sf_dir), A.configured_roster(spark, sf_dir))


@query("registry_anti")
def registry_anti(spark, sf_dir):
    return devices.registry_anti(A.fleet_roster(spark, sf_dir), A.configured_roster(spark, sf_dir)).select(*KEY)


@query("site_upsert")
def site_upsert(spark, sf_dir):
    """Sites with customers are configured again: some without coordinates or horizon."""
    n = F.col("c_nationkey")
    configured = A.read(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("k")).where(n % 3 != 0).select(
        F.concat(F.lit("N"), "c_nationkey").alias("site_id"),
        F.when(n % 2 == 0, n * 1.5).alias("latitude"), F.when(n % 2 == 0, n * 2.5).alias("longitude"),
        F.when(n % 4 == 0, F.lit(-2.0)).alias("horizon_deg"))
    return devices.site_upsert(A.nation_sites(spark, sf_dir), configured)


@query("daily_upsert")
def daily_upsert(spark, sf_dir):
    """Stored meter days, of which the grid meters' second half is computed anew with other limits."""
    path = f"{work_dir(spark, 'daily')}/meter_daily"
    S.upsert_days(spark, _meter_days(spark, sf_dir), path)
    again = _meter_days(spark, sf_dir, LOOSE).where(
        (F.col("device_name") == "grid") & (F.col("day") >= dt.date(2024, 1, 15)))
    S.upsert_days(spark, again, path)
    return spark.read.schema(again.schema).parquet(path).select(
        *KEY, "day", "imported_kwh", "exported_kwh", "coverage", "complete", "continuity", "continuous", "sample_count", "notes")


# --- derivations -------------------------------------------------------------

LINE = ["l_orderkey", "l_linenumber"]


@query("scale_to_kilo")
def scale_to_kilo(spark, sf_dir):
    return A.electrical(spark, sf_dir).select(*LINE, N.scale_to_kilo("s").alias("kilo"))


@query("quantise")
def quantise(spark, sf_dir):
    x = F.col("s") * F.col("q") / 7.0
    return A.electrical(spark, sf_dir).select(*LINE, *(N.quantise(x, k).alias(k) for k in ("energy", "voltage", "current", "power")))


@query("float_narrow")
def float_narrow(spark, sf_dir):
    return A.electrical(spark, sf_dir).select(*LINE, N.narrow("s").alias("narrowed"), N.narrow(F.col("q") / 3.0).alias("third"))


@query("efficiency")
def efficiency(spark, sf_dir):
    return A.electrical(spark, sf_dir).select(*LINE, N.efficiency("q", "dc").alias("efficiency"))


@query("hybrid_null")
def hybrid_null(spark, sf_dir):
    return A.inverter_readings(spark, sf_dir).select(*KEY, "seq", "hybrid", N.hybrid_null("ac_energy", "hybrid").alias("dc_energy"))


@query("energy_from_sunspec")
def energy_from_sunspec(spark, sf_dir):
    """More active than apparent energy has no reactive part: not a number."""
    e = N.reactive_energy("s", "p", "q")
    return A.electrical(spark, sf_dir).select(
        *LINE, F.isnan(e).alias("not_a_number"), N.round_half_away(F.when(~F.isnan(e), e), 6).alias("reactive"))


@query("energy_from_proprietary")
def energy_from_proprietary(spark, sf_dir):
    return A.electrical(spark, sf_dir).select(*LINE, N.round_half_away(N.apparent_energy("p", "q"), 6).alias("apparent"))


@query("current_total")
def current_total(spark, sf_dir):
    phases = F.array(F.col("q") / 3.0, F.col("q") / 5.0, F.col("q") / 7.0)
    return A.electrical(spark, sf_dir).select(*LINE, "register_map", N.current_total(phases, "q", "register_map").alias("current"))


DERIVED = ["energy_active_import", "energy_active_export", "energy_apparent_import", "energy_apparent_export",
           "energy_reactive_import", "energy_reactive_export", "power_active", "power_apparent", "power_reactive",
           "power_factor", "frequency", "voltage_ph", "voltage_pp", "current"]


@query("grid_assumption_derive")
def grid_assumption_derive(spark, sf_dir):
    measured = A.electrical(spark, sf_dir).select(
        *LINE, F.col("s").alias("energy"), F.col("p").alias("power"),
        F.array(F.col("p") / 2.0, F.col("p") / 4.0, F.col("q") * 1.0).alias("phase_power"),
        F.array(F.col("v"), F.col("v") + 1.0, F.col("v") + 2.0).alias("phase_voltage"))
    df = electrical.grid_assumption_derive(measured, electrical.Grid(0.98, 50.0, False))
    first = F.col("phases")[0]
    return _rounded(df.select(*LINE, *DERIVED, first["current"].alias("current_1"), first["voltage_pp"].alias("voltage_pp_1"),
                              first["power_reactive"].alias("power_reactive_1")),
                    [*DERIVED, "current_1", "voltage_pp_1", "power_reactive_1"], 6)


@query("telegram_ingest")
def telegram_ingest(spark, sf_dir):
    parsed = TG.parse_telegrams(A.telegrams(spark, sf_dir))
    df = TG.telegram_devices(TG.telegram_readings(parsed))
    return df.select(*KEY, "seq", "received_at", "serial_number", "firmware_version", "manufacturer", "model", "phases",
                     "energy", "power", F.col("phase_power")[1].alias("power_2"), F.col("phase_voltage")[2].alias("voltage_3"))


@query("telegram_rejects")
def telegram_rejects(spark, sf_dir):
    return TG.telegram_rejects(TG.parse_telegrams(A.telegrams(spark, sf_dir))).drop("telegram", "received_at")


@query("meter_identity_nulls")
def meter_identity_nulls(spark, sf_dir):
    return devices.meter_identity_nulls(A.supplier_devices(spark, sf_dir)).select(
        *KEY, "serial_number", "register_model", "meter_id", "slave_id")


@query("day_filter")
def day_filter(spark, sf_dir):
    df = TU.in_local_days(A.readings(spark, sf_dir), dt.date(2024, 1, 5), dt.date(2024, 1, 24), TZ)
    return df.groupBy(*KEY, TU.local_day("time", TZ).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("t0"), F.max("time").alias("t1"))


@query("site_ratios")
def site_ratios(spark, sf_dir):
    df = _rollup(spark, sf_dir, LOOSE).where("written")
    return _rounded(reports.site_ratios(df), ["self_sufficiency", "self_usage"])


@query("constraint_split")
def constraint_split(spark, sf_dir):
    df = validation.constraint_split(A.supplier_devices(spark, sf_dir), validation.rule_sets()["inverter_device"])
    return df.select(*KEY, "serial_number", F.array_join("violations", ",").alias("violations"))


@query("constraint_split_meter")
def constraint_split_meter(spark, sf_dir):
    df = devices.meter_identity_nulls(A.supplier_devices(spark, sf_dir))
    return validation.valid_rows(df, validation.rule_sets()["meter_device"]).select(*KEY, "serial_number")


@query("registry_validate")
def registry_validate(spark, sf_dir):
    df = validation.registry_validate(A.customer_roster(spark, sf_dir))
    return df.select(*KEY, "kind", "location", "is_primary", F.array_join("violations", ",").alias("violations"))


# --- joins -------------------------------------------------------------------

def _power(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    return power.downsample(A.power_rows(spark, sf_dir), seconds)


@query("overlap_full_join")
def overlap_full_join(spark, sf_dir):
    return _rounded(site.overlap_full_join(_power(spark, sf_dir, 30), site.contributors(A.registry(spark, sf_dir)), TZ), ["pw", "cw"])


@query("registry_join")
def registry_join(spark, sf_dir):
    """Device sightings of the fleet's meters only."""
    return site.registry_join(A.fleet_roster(spark, sf_dir).select(*KEY, "location"), A.configured_roster(spark, sf_dir), "meter")


@query("primary_meter_lookup")
def primary_meter_lookup(spark, sf_dir):
    return site.primary_meter_lookup(A.fleet_roster(spark, sf_dir))


@query("daylight_join")
def daylight_join(spark, sf_dir):
    spine = _spine(spark, sf_dir).where("kind = 'inverter'")
    calendar = solar.daylight_calendar(
        solar.site_days(A.sites(spark, sf_dir), spine.select("site_id", "day").distinct()), TZ)
    return daily.daylight_join(spine.select(*KEY, "day"), calendar)


def _contributor_days(spark: SparkSession, sf_dir: str, limits=LOOSE) -> DataFrame:
    spine = _spine(spark, sf_dir)
    roster_days = site.contributors(A.registry(spark, sf_dir)).join(spine.select("site_id", "day").distinct(), "site_id")
    return site.contributor_left_join(
        roster_days, site.device_days(_inverter_days(spark, sf_dir, limits), _meter_days(spark, sf_dir, limits)))


@query("contributor_left_join")
def contributor_left_join(spark, sf_dir):
    return _contributor_days(spark, sf_dir).select(
        *KEY, "day", "role", "produced_kwh", "imported_kwh", "exported_kwh", "complete", "continuous")


@query("device_asof")
def device_asof(spark, sf_dir):
    readings = A.readings(spark, sf_dir).where("event_type <> 'signup'").select(*KEY, "seq", "value")
    known = A.device_sightings(spark, sf_dir).withColumnRenamed("seq", "announced").withColumn("seq", F.col("announced"))
    df = ordered.device_asof(readings, known, KEY, "seq", ["announced", "serial_number", "firmware_version"], chunk_rows=1000)
    return df.where(F.col("descriptor").isNotNull()).select(*KEY, "seq", "value", "descriptor.*")


# --- aggregations ------------------------------------------------------------

@query("counter_boundary")
def counter_boundary(spark, sf_dir):
    df = counters.counter_boundary(A.inverter_samples(spark, sf_dir), ["ac_energy"], TZ)
    return df.select(*KEY, "day", "ac_energy_count", "ac_energy_first", "ac_energy_last", "ac_energy_first_time", "ac_energy_last_time")


@query("counter_delta")
def counter_delta(spark, sf_dir):
    imp, exp = "energy_active_import", "energy_active_export"
    df = counters.counter_boundary(A.meter_samples(spark, sf_dir), [imp, exp], TZ)
    return df.select(*KEY, "day", counters.counter_delta(f"{imp}_first", f"{imp}_last").alias("imported_kwh"),
                     counters.counter_delta(f"{exp}_first", f"{exp}_last").alias("exported_kwh"))


@query("bucket_presence")
def bucket_presence(spark, sf_dir):
    return counters.bucket_presence(A.readings(spark, sf_dir), TZ)


@query("power_30sec")
def power_30sec(spark, sf_dir):
    return _power(spark, sf_dir, power.POWER_30SEC)


@query("power_5min")
def power_5min(spark, sf_dir):
    return _power(spark, sf_dir, power.POWER_5MIN)


@query("coverage")
def coverage(spark, sf_dir):
    return _meter_days(spark, sf_dir).select(*KEY, "day", "coverage").unionByName(
        _inverter_days(spark, sf_dir).select(*KEY, "day", "coverage"))


@query("continuity")
def continuity(spark, sf_dir):
    return _meter_days(spark, sf_dir).select(*KEY, "day", "continuity").unionByName(
        _inverter_days(spark, sf_dir).select(*KEY, "day", "continuity"))


@query("site_production")
def site_production(spark, sf_dir):
    return _rounded(site.site_production(_inverter_days(spark, sf_dir), A.registry(spark, sf_dir)), ["production_kwh"])


@query("pv_power_by_bucket")
def pv_power_by_bucket(spark, sf_dir):
    return _rounded(site.pv_power_by_bucket(_power(spark, sf_dir, 30), A.registry(spark, sf_dir), TZ), ["pw"])


@query("self_consumption_overlap")
def self_consumption_overlap(spark, sf_dir):
    overlap = site.overlap_full_join(_power(spark, sf_dir, 3600), site.contributors(A.registry(spark, sf_dir)), TZ)
    return _rounded(site.self_consumption_overlap(overlap, 3600), ["overlap_kwh"])


@query("quality_and")
def quality_and(spark, sf_dir):
    return site.quality(_contributor_days(spark, sf_dir))


@query("incomplete_list")
def incomplete_list(spark, sf_dir):
    return site.incomplete_list(_contributor_days(spark, sf_dir))


@query("site_energy")
def site_energy(spark, sf_dir):
    """The stored rows: days that end early with a note are not among them."""
    stored = _rollup(spark, sf_dir, LOOSE).where("written").drop("written", "notes")
    return _rounded(stored, SITE_FIGURES)


@query("completeness_stats")
def completeness_stats(spark, sf_dir):
    return reports.completeness_stats(_rollup(spark, sf_dir, LOOSE).where("written"), ["site_id"])


@query("data_span")
def data_span(spark, sf_dir):
    return reports.data_span(A.readings(spark, sf_dir), TZ)


# --- ordered operators ---------------------------------------------------------

@query("suppress_repeats")
def suppress_repeats(spark, sf_dir):
    return ordered.suppress_repeats(A.event_messages(spark, sf_dir), chunk_rows=1000).select("topic", "payload", "seq")


@query("change_gate")
def change_gate(spark, sf_dir):
    """A descriptor is announced only when its serial or firmware changed."""
    df = ordered.change_gate(A.device_sightings(spark, sf_dir), KEY, "seq", ["serial_number", "firmware_version"], chunk_rows=1000)
    return df.select(*KEY, "seq", "serial_number", "firmware_version")


@query("first_wins_dedup")
def first_wins_dedup(spark, sf_dir):
    df = ordered.first_wins(A.duplicated(A.inverter_samples(spark, sf_dir)), [*KEY, "time"])
    return df.select(*KEY, "time", "seq", "ac_power_active")


@query("site_report")
def site_report(spark, sf_dir):
    df = reports.site_report(_rollup(spark, sf_dir).where("written"))
    return _rounded(df, ["self_sufficiency", "self_usage"])


@query("latest_per_topic")
def latest_per_topic(spark, sf_dir):
    return reports.latest_per_topic(A.event_messages(spark, sf_dir))


@query("latest_sample")
def latest_sample(spark, sf_dir):
    return reports.latest_sample(A.meter_samples(spark, sf_dir)).drop("day")


@query("inverter_union")
def inverter_union(spark, sf_dir):
    df = site.inverter_union(_power(spark, sf_dir, 30))
    return df.select("site_id", "bucket", F.greatest("avg_power", F.lit(0.0)).alias("p"))


@query("contributors")
def contributors(spark, sf_dir):
    return site.contributors(A.fleet_roster(spark, sf_dir)).select(*KEY, "role")


# --- calendar ------------------------------------------------------------------

@query("day_spine")
def day_spine(spark, sf_dir):
    return _spine(spark, sf_dir)


@query("day_bounds")
def day_bounds(spark, sf_dir):
    days = A.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return TU.day_bounds(days, TZ)


@query("time_bucket")
def time_bucket(spark, sf_dir):
    df = A.readings(spark, sf_dir)
    return df.select("seq", TU.time_bucket("time", 30).alias("bucket_30s"), TU.time_bucket("time", 300).alias("bucket_5min"))


@query("daylight_calendar")
def daylight_calendar(spark, sf_dir):
    days = solar.site_days(A.nation_sites(spark, sf_dir), A.nation_site_days(spark, sf_dir))
    df = solar.daylight_calendar(days, TZ)
    epoch = F.lit("1970-01-01").cast("timestamp")
    return df.select("site_id", "day", "seconds", F.unix_seconds(epoch + F.col("daylight")).alias("daylight_s"), "sunrise", "sunset")


@query("solar_daylight")
def solar_daylight(spark, sf_dir):
    """The SQL table function, joined laterally to every site and day."""
    solar.register_solar_daylight(spark)
    days = solar.site_days(A.nation_sites(spark, sf_dir), A.nation_site_days(spark, sf_dir))
    return spark.sql(
        """SELECT p.site_id, p.day, d.seconds, d.sunrise, d.sunset
           FROM {days} p, LATERAL solar_daylight(p.latitude, p.longitude, p.day, :tz, p.horizon_deg) d""",
        {"tz": TZ}, days=days)


# --- streams and lifecycle -------------------------------------------------------

def _drain(started) -> None:
    started.awaitTermination()


def _stream_power(spark: SparkSession, sf_dir: str, resolution) -> DataFrame:
    base = work_dir(spark, resolution.table)
    rows = A.as_readings(A.read_stream(spark, sf_dir, "events")).select(*KEY, "kind", "time", "power")
    _drain(SP.start_power(rows, resolution, f"{base}/table", f"{base}/checkpoint", available_now=True))
    return spark.read.schema(tables.TABLES["power_30sec"]).parquet(f"{base}/table").drop("day")


@query("stream_power_30sec")
def stream_power_30sec(spark, sf_dir):
    return _stream_power(spark, sf_dir, SP.THIRTY_SECONDS)


@query("stream_power_5min")
def stream_power_5min(spark, sf_dir):
    return _stream_power(spark, sf_dir, SP.FIVE_MINUTES)


@query("refresh_range")
def refresh_range(spark, sf_dir):
    return power.refresh_range(A.power_rows(spark, sf_dir), 300, dt.datetime(2024, 1, 28, 12, 3, 20),
                               dt.timedelta(days=25, hours=2), dt.timedelta(minutes=10))


@query("stream_dedup")
def stream_dedup(spark, sf_dir):
    """Every event arrives twice; the stream lets the first reading of an instant through."""
    base = work_dir(spark, "dedup")
    events = A.read_stream(spark, sf_dir, "events").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = A.as_readings(events).select(*KEY, "time", "seq", "power")
    _drain(SI.stream_dedup(rows).writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/table"))
    return spark.read.parquet(f"{base}/table")


@query("stream_device_state")
def stream_device_state(spark, sf_dir):
    """Readings with the descriptor known when they arrived, over a stream of both."""
    base = work_dir(spark, "state")
    rows = A.as_readings(A.read_stream(spark, sf_dir, "events")).select(
        *KEY, "seq", "value", (F.col("event_type") == "signup").alias("is_device"),
        F.concat(F.lit("SN"), F.col("user_id") % 3).alias("serial_number"),
        F.concat(F.lit("fw"), F.floor("value")).alias("firmware_version"))
    _drain(SD.start_device_state(rows, base, f"{base}/checkpoint", ["serial_number", "firmware_version"],
                                 available_now=True, chunk_rows=1000))
    return spark.read.parquet(f"{base}/readings").select(*KEY, "seq", "value", "descriptor.*")


@query("live_day_rollup")
def live_day_rollup(spark, sf_dir):
    """The stored site balance after a stream of samples has been followed to its end."""
    store = _store(spark, sf_dir)
    both = [spark.readStream.schema(tables.TABLES[t]).parquet(f"{store}/{t}").select("site_id", "time")
            for t in ("inverter_samples", "meter_samples")]
    samples = both[0].unionByName(both[1])
    _drain(SL.start_live_rollup(samples, store, TZ, f"{store}/_checkpoint", available_now=True))
    return _rounded(tables.read_table(spark, store, "site_energy"), SITE_FIGURES)


@query("stream_json_ingest")
def stream_json_ingest(spark, sf_dir):
    """Messages streamed into the three inverter tables, joined again for the comparison."""
    base = work_dir(spark, "ingest")
    _messages(spark, sf_dir, "inverter").write.parquet(f"{base}/messages")
    stream = spark.readStream.schema("topic string, payload string, seq bigint").parquet(f"{base}/messages")
    _drain(SI.start_ingest(stream, base, "inverter", f"{base}/checkpoint", available_now=True))
    at = [*KEY, "time"]
    phases = tables.read_table(spark, base, "inverter_phase_samples").groupBy(*at).agg(
        F.count(F.lit(1)).alias("n_phases"), F.max("ac_voltage").alias("max_voltage"))
    inputs = tables.read_table(spark, base, "inverter_input_samples").groupBy(*at).agg(
        F.count(F.lit(1)).alias("n_inputs"), F.max("dc_energy").alias("max_dc_energy"))
    samples = tables.read_table(spark, base, "inverter_samples").select(*at, "seq", "ac_energy", "ac_power_active", "efficiency")
    return samples.join(phases, at, "left").join(inputs, at, "left")


def _ingested(spark: SparkSession, sf_dir: str, kind: str, change=lambda df: df) -> str:
    """A store filled from messages whose phases come in reverse order."""
    base = work_dir(spark, "ingest")
    schema = PAYLOADS[kind, "values"]
    turned = F.from_json("payload", schema)
    fields = [F.reverse(turned["phases"]).alias(n) if n == "phases" else turned[n].alias(n)
              for n in (f.name for f in spark.createDataFrame([], schema).schema)]
    messages = _messages(spark, sf_dir, kind).withColumn("payload", F.to_json(F.struct(*fields)))
    change(messages).select("topic", "payload", "seq").write.parquet(f"{base}/messages")
    stream = spark.readStream.schema("topic string, payload string, seq bigint").parquet(f"{base}/messages")
    _drain(SI.start_ingest(stream, base, kind, f"{base}/checkpoint", available_now=True))
    return base


@query("stream_json_phases")
def stream_json_phases(spark, sf_dir):
    """Phase rows of inverter messages: the numbers are those of the items, not their places."""
    base = _ingested(spark, sf_dir, "inverter")
    return tables.read_table(spark, base, "inverter_phase_samples").drop("day")


@query("stream_json_ingest_meter")
def stream_json_ingest_meter(spark, sf_dir):
    """Meter messages streamed into their two tables, joined again for the comparison."""
    base = _ingested(spark, sf_dir, "meter")
    at = [*KEY, "time"]
    phases = tables.read_table(spark, base, "meter_phase_samples").select(*at, "phase_id", F.col("power_active").alias("phase_power"))
    return tables.read_table(spark, base, "meter_samples").select(*at, "seq", "energy_active_import", "power_active").join(phases, at)


@query("stream_json_rejects")
def stream_json_rejects(spark, sf_dir):
    """Messages that were not stored, by reason: cut payloads, unknown topics, phases that do not exist."""

    def spoil(df: DataFrame) -> DataFrame:
        return df.withColumns({
            "payload": F.when(F.col("seq") % 97 == 0, F.substring("payload", 1, 12)).when(
                F.col("seq") % 103 == 0, F.regexp_replace("payload", '"id":', '"id":1')).otherwise(F.col("payload")),
            "topic": F.when(F.col("seq") % 101 == 0, "broken").otherwise(F.col("topic"))})

    base = _ingested(spark, sf_dir, "inverter", spoil)
    return tables.read_table(spark, base, "message_rejects").groupBy(
        F.regexp_replace("reason", "(phase|input)_id", "id").alias("reason"), F.coalesce("seq", F.lit(-1)).alias("seq")).agg(
        F.count(F.lit(1)).alias("n"))


@query("retention")
def retention(spark, sf_dir):
    """Raw samples left after the partitions older than 90 days are dropped."""
    store = _store(spark, sf_dir)
    S.apply_retention(spark, store, dt.datetime(2024, 4, 10))
    return tables.read_table(spark, store, "inverter_samples").select(*KEY, "time", "seq", "ac_energy")


@query("compaction")
def compaction(spark, sf_dir):
    """All samples, unchanged after the older partitions were rewritten."""
    store = _store(spark, sf_dir)
    S.compact(spark, f"{store}/inverter_samples", dt.datetime(2024, 1, 25))
    return tables.read_table(spark, store, "inverter_samples").select(*KEY, "time", "seq", "ac_energy")
