"""Adapters: the given tables as telemetry of two sites with five devices each.

Counters are running sums of whole hundredths, so they are exact whatever the
order of addition.  The sums run per quarter hour and carry the totals of
earlier quarters, because a window over a whole device would be one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sunledger import KEY
from sunledger.functions.timeutil import time_bucket

TZ = "Europe/Berlin"
DEVICES = ["inv0", "inv1", "grid", "heatpump", "aux"]
CHUNK_SECONDS = 900


# Schemas of the given tables, so that no job has to infer them.
GIVEN = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(GIVEN[table]).parquet(f"{sf_dir}/{table}.parquet")


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.readStream.schema(GIVEN[table]).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def as_readings(events: DataFrame) -> DataFrame:
    """Events as device readings; works on a stream too."""
    dv = F.floor(F.col("user_id") / 2) % 5
    return events.select(
        F.concat(F.lit("S"), F.col("user_id") % 2).alias("site_id"),
        F.element_at(F.array(*map(F.lit, DEVICES)), dv.cast("int") + 1).alias("device_name"),
        F.when(dv < 2, "inverter").otherwise("meter").alias("kind"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("time"),
        "user_id", "event_type", "value",
        F.rint(F.col("value") * 100).cast("long").alias("cents"),
        (F.col("value") - 20).cast("float").alias("power"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_readings(read(spark, sf_dir, "events"))


def with_running_totals(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add ``<col>_total``, the running sum per device in time order."""
    parts = [*KEY, "_chunk"]
    df = df.withColumn("_chunk", time_bucket("time", CHUNK_SECONDS))
    before = Window.partitionBy(*KEY).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*parts).agg(*(F.sum(c).alias(f"_{c}") for c in cols)).select(
        *parts, *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_before") for c in cols))
    within = Window.partitionBy(*parts).orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(offsets, parts).withColumns(
        {f"{c}_total": F.col(f"_{c}_before") + F.sum(c).over(within) for c in cols})
    return joined.drop("_chunk", *(f"_{c}_before" for c in cols))


def _counted(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    df = readings(spark, sf_dir).where(F.col("kind") == kind)
    out = F.when(F.col("event_type").isin("click", "view"), F.col("cents")).otherwise(F.lit(0))
    return with_running_totals(df.withColumn("sent", out), ["cents", "sent"])


def _import_kwh():
    return (F.when(F.col("seq") % 50 == 0, F.lit(None).cast("double"))
            .when(F.col("seq") % 47 == 0, F.lit(0.0))
            .otherwise(F.col("cents_total") / 100000.0))


def inverter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "inverter").select(
        *KEY, "time", "seq", _import_kwh().alias("ac_energy"),
        F.col("power").alias("ac_power_active"), F.to_date("time").alias("day"))


def meter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    exported = F.when(F.col("seq") % 50 == 0, F.lit(None).cast("double")).otherwise(F.col("sent_total") / 100000.0)
    return _counted(spark, sf_dir, "meter").select(
        *KEY, "time", "seq", _import_kwh().alias("energy_active_import"),
        exported.alias("energy_active_export"), F.col("power").alias("power_active"), F.to_date("time").alias("day"))


def power_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select(*KEY, "kind", "time", "power")


def seen_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every device with its first and last reading: what roster, sites and spine need of the readings."""
    return readings(spark, sf_dir).groupBy(*KEY, "kind").agg(F.min("time").alias("t0"), F.max("time").alias("t1"))


def registry(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    """The roster: S0 is metered at the feed-in point, S1 in the consumption path."""
    devices = (readings(spark, sf_dir) if seen is None else seen).select(*KEY, "kind").distinct()
    grid, heatpump = F.col("device_name") == "grid", F.col("device_name") == "heatpump"
    return devices.withColumns({
        "location": F.when(grid & (F.col("site_id") == "S0"), "feed-in").when(grid | heatpump, "consumption"),
        "is_primary": grid,
    })


def sites(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    """S0 has coordinates, S1 has none."""
    first = F.col("site_id") == "S0"
    return (readings(spark, sf_dir) if seen is None else seen).select("site_id").distinct().withColumns({
        "latitude": F.when(first, F.lit(49.07)),
        "longitude": F.when(first, F.lit(9.15)),
        "horizon_deg": F.lit(-0.833),
    })


def nation_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites from pole to pole, one per nation."""
    key = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(
        F.concat(F.lit("N"), key).alias("site_id"),
        (F.lit(-84.0) + key * 7.0).alias("latitude"),
        (F.lit(-180.0) + key * 14.4).alias("longitude"),
        F.lit(-0.833).alias("horizon_deg"))


def nation_site_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, day) of every order, by the nation of its customer."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).join(
        customers, "o_custkey").select(F.concat(F.lit("N"), "c_nationkey").alias("site_id"), "day").distinct()


def customer_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large roster with faults: customers as devices of their nation's site."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("N"), "c_nationkey").alias("site_id"),
        F.when(k % 11 == 0, "meter").when(k % 13 == 0, "bad name").when(k % 17 == 0, F.repeat(F.lit("x"), 40))
        .when(k % 19 == 0, "").otherwise(F.concat(F.lit("dev_"), k % 700)).alias("device_name"),
        F.when(k % 3 == 0, "inverter").otherwise("meter").alias("kind"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 2 == 0, "feed-in").otherwise("consumption").alias("location"),
        ((k % 30 == 1) | (k % 60 == 4)).alias("is_primary"))


def supplier_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device descriptors, some with invalid phases, inputs, address or register model."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("N"), "s_nationkey").alias("site_id"),
        F.concat(F.lit("dev_"), k % 10).alias("device_name"),
        F.col("s_name").alias("serial_number"),
        F.lit("maker").alias("manufacturer"), F.concat(F.lit("model-"), k % 4).alias("model"),
        F.concat(F.lit("1."), k % 7).alias("firmware_version"),
        F.when(k % 5 == 0, "").when(k % 7 == 0, "other").when(k % 2 == 0, "float").otherwise("int+sf").alias("register_model"),
        (k % 3).cast("int").alias("meter_id"), (k * 3).cast("int").alias("slave_id"),
        (k % 4).cast("short").alias("mppt_tracker"), (k % 5 + 1).cast("short").alias("phases"))


def device_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptor announcements: every signup event is one, the hardware changes now and then."""
    return readings(spark, sf_dir).where(F.col("event_type") == "signup").select(
        *KEY, F.concat(F.lit("SN"), F.col("user_id") % 3).alias("serial_number"),
        F.concat(F.lit("fw"), F.floor("value")).alias("firmware_version"),
        F.col("user_id").cast("int").alias("slave_id"), "seq", F.col("time").alias("ts"))


def inverter_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings before derivation and rounding, Wh-family, three phases and two inputs."""
    v = F.col("value")
    wh = F.col("cents_total") / 100.0

    def phase(i: int):
        return F.struct((v * 0.01 + (230.0 + i)).alias("ac_voltage"), (v / 230.0 / i).alias("ac_current"))

    def dc_input(i: int):
        return F.struct((v * 0.1 + (290.0 + i)).alias("dc_voltage"), (v / 290.0 / i).alias("dc_current"),
                        (v * 0.5 * i).alias("dc_power"), (wh * 0.5 * i).alias("dc_energy"))

    return _counted(spark, sf_dir, "inverter").select(
        *KEY, "time", "seq", wh.alias("ac_energy"), (v - 20.0).alias("ac_power_active"),
        (F.abs(v - 20.0) * 1.02).alias("ac_power_apparent"), (v * 0.1).alias("ac_power_reactive"),
        (100.0 - F.col("seq") % 200).alias("ac_power_factor"), (50.0 + (F.col("seq") % 7) * 0.013).alias("ac_frequency"),
        F.when(F.col("seq") % 13 == 0, 0.0).otherwise(v * 1.07).alias("dc_power"),
        F.array(*map(phase, (1, 2, 3))).alias("phases"), F.array(*map(dc_input, (1, 2))).alias("inputs"),
        (F.col("user_id") % 3 + 1).cast("int").alias("phase_count"),
        (F.col("user_id") % 2 + 1).cast("int").alias("input_count"),
        (F.col("user_id") % 4 == 0).alias("hybrid"))


def meter_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    imp, exp = F.col("cents_total") / 100.0, F.col("sent_total") / 100.0

    def phase(i: int):
        return F.struct(
            (v * i - 20.0).alias("power_active"), (v * 1.02 * i).alias("power_apparent"), (v * 0.1 * i).alias("power_reactive"),
            (F.lit(0.25) * i).alias("power_factor"), (v * 0.01 + (230.0 + i)).alias("voltage_ph"),
            (v * 0.02 + (398.0 + i)).alias("voltage_pp"), (v / 230.0 / i).alias("current"))

    return _counted(spark, sf_dir, "meter").select(
        *KEY, "time", "seq", imp.alias("energy_active_import"), exp.alias("energy_active_export"),
        (imp * 1.1).alias("energy_apparent_import"), (exp * 1.1).alias("energy_apparent_export"),
        (imp * 0.3).alias("energy_reactive_import"), (exp * 0.3).alias("energy_reactive_export"),
        (v - 20.0).alias("power_active"), (v * 1.02).alias("power_apparent"), (v * 0.1).alias("power_reactive"),
        F.lit(0.97).alias("power_factor"), F.lit(50.0).alias("frequency"), (v * 0.01 + 230.0).alias("voltage_ph"),
        (v * 0.02 + 398.0).alias("voltage_pp"), (v / 230.0).alias("current"),
        F.array(*map(phase, (1, 2, 3))).alias("phases"), (F.col("user_id") % 3 + 1).cast("int").alias("phase_count"))


def electrical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Electrical quantities from order lines: signed Q, sometimes no voltage or P above S."""
    s = F.col("l_extendedprice")
    q = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", s.alias("s"), q.alias("q"),
        F.when(F.col("l_linenumber") == 5, s * 1.5).otherwise(s * (1.0 - F.col("l_discount"))).alias("p"),
        F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_discount") * 100.0 + 230.0).alias("v"),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_quantity") * 2.0).alias("dc"),
        F.when(F.col("l_linestatus") == "O", "proprietary").otherwise("sunspec").alias("register_map"))


def telegrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telegram texts of the meters: every 20th has a broken line, every 33rd lost its end."""
    df = _counted(spark, sf_dir, "meter")
    watts = F.format_string("%.2f", (F.col("cents") - 2000) / 100.0)
    eol = "\r\n"

    def line(code: str, value):
        return F.concat(F.lit(f"1-0:{code}*255("), value, F.lit(")"))

    text = F.concat_ws(
        eol,
        F.lit("/MTR5BZ06_107"), F.lit(""),
        line("96.1.0", F.concat(F.lit("1M"), "site_id", "device_name")),
        F.when(F.col("seq") % 20 == 0, F.lit("1-0:1.8.0*255")).otherwise(
            line("1.8.0", F.format_string("%08d.%05d*kWh", F.floor(F.col("cents_total") / 100000), F.col("cents_total") % 100000))),
        line("16.7.0", F.concat(watts, F.lit("*W"))),
        *(line(f"{n}.7.0", F.concat(F.format_string("%.2f", F.col("cents") * i / 100.0), F.lit("*W")))
          for i, n in enumerate((36, 56, 76), 1)),
        *(line(f"{n}.7.0", F.concat(F.format_string("%.1f", 230.0 + F.col("seq") % (10 * i)), F.lit("*V")))
          for i, n in enumerate((32, 52, 72), 1)),
        line("0.2.0", F.lit("unused")),
    )
    end = F.when(F.col("seq") % 33 == 0, F.lit(eol)).otherwise(F.lit(f"{eol}!{eol}"))
    return df.select(*KEY, "seq", "cents", "cents_total", F.col("time").alias("received_at"), F.concat(text, end).alias("telegram"))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic per device whose payload often repeats."""
    return readings(spark, sf_dir).select(
        F.concat_ws("/", F.lit("fleet"), "site_id", "kind", "device_name", F.lit("availability")).alias("topic"),
        F.col("event_type").alias("payload"), "seq", F.col("time").alias("ts"))


def duplicated(samples: DataFrame) -> DataFrame:
    """Samples with every tenth delivered a second time, later and with other content."""
    again = samples.where(F.col("seq") % 10 == 0).withColumns({
        "seq": F.col("seq") + 1_000_000_000, "ac_power_active": F.lit(-1.0).cast("float")})
    return samples.unionByName(again)


def fleet_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large valid roster: customers as devices, sites by nation, some sites without a primary meter."""
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "inverter").otherwise("meter")
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("N"), "c_nationkey").alias("site_id"), F.concat(F.lit("dev_"), k).alias("device_name"),
        kind.alias("kind"), F.when(k % 3 == 1, "feed-in").when(k % 6 == 2, "consumption").alias("location"),
        ((k % 3 != 0) & (k % 31 == 0)).alias("is_primary"))


def configured_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new configuration of the even-numbered sites: a fifth of the devices gone, the others primary-less."""
    k = F.col("c_custkey")
    gone = (k % 5 == 0) | (F.col("c_nationkey") % 2 == 1)
    return read(spark, sf_dir, "customer").where(~gone).select(
        F.concat(F.lit("N"), "c_nationkey").alias("site_id"), F.concat(F.lit("dev_"), k).alias("device_name"),
        F.lit("meter").alias("kind"), F.lit(None).cast("string").alias("location"), F.lit(False).alias("is_primary"))


def write_store(spark: SparkSession, sf_dir: str, store: str) -> None:
    """A store folder with the adapter's samples, roster and sites."""
    for table, df in (("inverter_samples", inverter_samples(spark, sf_dir)), ("meter_samples", meter_samples(spark, sf_dir))):
        df.write.partitionBy("day").parquet(f"{store}/{table}")
    registry(spark, sf_dir).write.parquet(f"{store}/device_registry")
    sites(spark, sf_dir).write.parquet(f"{store}/site")
