"""The SQL function agrees with the column expressions; reports run as SQL."""

import datetime as dt


from sunledger.functions import solar
from sunledger.plans import sql_surface
from sunledger.session import work_dir
from sunledger.sources import driver_tables as A

SF = "/root/testdata/sf0.001"


def test_daylight_function(spark):
    solar.register_solar_daylight(spark)
    row = spark.sql("SELECT * FROM solar_daylight(49.07, 9.15, DATE'2026-12-21', 'Europe/Berlin')").first()
    assert row.seconds == 29555 and row.sunset - row.sunrise == row.daylight
    days = solar.site_days(A.nation_sites(spark, SF), A.nation_site_days(spark, SF))
    days.createOrReplaceTempView("place_days")
    by_sql = spark.sql("""SELECT p.site_id, p.day, d.* FROM place_days p,
        LATERAL solar_daylight(p.latitude, p.longitude, p.day, 'Europe/Berlin', p.horizon_deg) d""")
    by_columns = solar.daylight_calendar(days, "Europe/Berlin").select(*by_sql.columns)
    rows = sorted(map(tuple, by_columns.collect()))
    assert len(rows) > 1000
    assert sorted(map(str, map(tuple, by_sql.collect()))) == sorted(map(str, rows))


def test_reports_as_sql(spark):
    store = work_dir(spark, "sql")
    spark.createDataFrame(
        [("S", dt.date(2024, 1, d), 4.0, c, 2.0, 0.0, 2.0, d == 1, True) for d, c in ((1, 8.0), (2, 0.0))],
        "site_id string, day date, production_kwh double, consumption_kwh double, self_consumption_kwh double, "
        "from_grid_kwh double, to_grid_kwh double, complete boolean, continuous boolean",
    ).write.partitionBy("day").parquet(f"{store}/site_energy")
    assert sql_surface.register(spark, store) == ["site_energy"]
    rows = spark.sql("""SELECT day, self_consumption_kwh / NULLIF(consumption_kwh, 0) AS self_sufficiency, complete
                        FROM site_energy ORDER BY day""").collect()
    assert [(r.day.day, r.self_sufficiency, r.complete) for r in rows] == [(1, 0.25, True), (2, None, False)]
    stats = spark.sql("SELECT count(*) AS days, count(*) FILTER (WHERE complete) AS complete_days FROM site_energy").first()
    assert (stats.days, stats.complete_days) == (2, 1)
