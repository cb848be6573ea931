"""Physical plans: what must and must not appear."""

import pytest

from sunledger.plans.oracle import ORACLE
from sunledger.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name, sf=SF):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", ["meter_daily", "inverter_daily", "power_30sec", "bucket_presence", "counter_boundary", "latest_sample"])
def test_rollups_hash_aggregate(spark, name):
    text = plan(spark, name)
    assert "HashAggregate" in text and "SortAggregate" not in text and "Expand" not in text


@pytest.mark.parametrize("name", ["scale_to_kilo", "quantise", "efficiency", "energy_from_sunspec", "grid_assumption_derive", "time_bucket"])
def test_projections_do_not_shuffle_and_prune(spark, name):
    text = plan(spark, name)
    assert "Exchange" not in text and "l_comment" not in text and "props" not in text


def test_one_shuffle_for_power(spark):
    assert plan(spark, "power_30sec").count("Exchange") == 1


def test_first_wins_limits_before_the_shuffle(spark):
    text = plan(spark, "first_wins_dedup")
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["suppress_repeats", "change_gate", "device_asof"])
def test_windows_over_rows_are_split_by_chunk(spark, name):
    text = plan(spark, name, "/root/testdata/sf0.1")    # a device has more rows than a chunk there
    windows = [line.split("windowspecdefinition(")[1] for line in text.splitlines() if "Window [" in line]
    assert windows and any("_chunk" in w for w in windows)
    assert "hashpartitioning" in text and "SinglePartition" not in text


@pytest.mark.parametrize("name", ["meter_daily", "inverter_daily", "overlap_full_join", "contributor_left_join", "registry_validate",
                                  "daylight_calendar", "device_asof", "telegram_ingest", "telemetry_json_scan", "first_wins_dedup"])
def test_no_cross_join_no_python(spark, name):
    text = plan(spark, name)
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "SinglePartition"):
        assert banned not in text, banned


@pytest.mark.parametrize("name", ["suppress_repeats", "change_gate", "device_asof", "device_upsert", "latest_per_topic"])
def test_ordered_operators_do_not_sort_to_aggregate(spark, name):
    assert "SortAggregate" not in plan(spark, name)
