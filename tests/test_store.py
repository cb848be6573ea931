"""Keyed writes, partition reads, retention and compaction on a store folder."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from sunledger import KEY
from sunledger.plans.rollup import refresh_power, run_site_rollup
from sunledger.session import work_dir
from sunledger.sources import fleet, store as S, tables as T

DAILY = "site_id string, device_name string, v int, day date"


def daily(spark, rows):
    return spark.createDataFrame([("S", d, v, dt.date(2024, 1, day)) for d, v, day in rows], DAILY)


def content(spark, path, cols=("device_name", "v", "day")):
    return sorted((r.device_name, r.v, r.day.day) for r in spark.read.schema(DAILY).parquet(path).select(*cols).collect())


def files(path):
    return {os.path.join(root, f): os.path.getmtime(os.path.join(root, f))
            for root, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_replaces_by_key_and_leaves_other_days(spark):
    path = work_dir(spark, "t")
    S.upsert_days(spark, daily(spark, [("a", 1, 1), ("b", 2, 1), ("a", 3, 2)]), path)
    untouched = {f: t for f, t in files(path).items() if "day=2024-01-02" in f}
    change = daily(spark, [("b", 20, 1), ("c", 30, 1), ("a", 40, 3)])
    for _ in range(2):  # twice gives the same as once
        S.upsert_days(spark, change, path)
        assert content(spark, path) == [("a", 1, 1), ("a", 3, 2), ("a", 40, 3), ("b", 20, 1), ("c", 30, 1)]
    assert untouched and all(files(path).get(f) == t for f, t in untouched.items())


def test_insert_first_never_replaces(spark):
    path = work_dir(spark, "t")
    S.insert_first(spark, daily(spark, [("a", 1, 1)]), path, KEY)
    for _ in range(2):
        S.insert_first(spark, daily(spark, [("a", 9, 1), ("a", 2, 2), ("b", 3, 1)]), path, KEY)
    assert content(spark, path) == [("a", 1, 1), ("a", 2, 2), ("b", 3, 1)]


def test_retention_drops_whole_old_days_only(spark):
    base = work_dir(spark, "t")
    for table in ("meter_samples", "power_30sec", "meter_daily"):
        daily(spark, [("a", i, i) for i in range(1, 11)]).write.partitionBy("day").parquet(f"{base}/{table}")
    gone = S.apply_retention(spark, base, dt.datetime(2024, 4, 4, 12))
    assert gone["meter_samples"] == [dt.date(2024, 1, d) for d in (1, 2, 3, 4)] and gone["power_30sec"] == []
    assert [d for _, _, d in content(spark, f"{base}/meter_samples")] == [5, 6, 7, 8, 9, 10]
    assert len(content(spark, f"{base}/meter_daily")) == 10
    assert S.apply_retention(spark, base, dt.datetime(2026, 1, 6))["power_30sec"] == [dt.date(2024, 1, d) for d in range(1, 6)]


@pytest.mark.parametrize("now, first_kept", [(dt.datetime(2024, 2, 29), dt.date(2022, 2, 28)), (dt.datetime(2024, 12, 31), dt.date(2022, 12, 31)),
                                             (dt.datetime(2024, 1, 1), dt.date(2022, 1, 1))])
def test_two_year_cutoff(now, first_kept):
    assert S.retention_cutoff("power_5min", now) == first_kept
    assert S.retention_cutoff("site_energy", now) is None


def test_compaction_rewrites_old_days_once(spark):
    path = work_dir(spark, "t")
    start = dt.datetime(2024, 1, 1)
    rows = spark.range(3000).select(
        F.lit("S").alias("site_id"), F.concat(F.lit("d"), F.col("id") % 3).alias("device_name"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 300).alias("time"), (F.col("id") % 2 + 1).alias("phase_id"))
    rows.withColumn("day", F.to_date("time")).repartition(4).write.partitionBy("day").parquet(path)
    before = sorted(map(tuple, spark.read.parquet(path).collect()))
    days = S.compact(spark, path, start + dt.timedelta(days=11), segment="phase_id")
    assert days == [dt.date(2024, 1, d) for d in (1, 2, 3, 4)]
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == before
    one = [r for r in spark.read.parquet(f"{path}/day=2024-01-01").select("phase_id", "device_name", "time").collect()]
    assert one == sorted(one, key=lambda r: (r.phase_id, r.device_name, -r.time.timestamp()))
    assert S.compact(spark, path, start + dt.timedelta(days=11), segment="phase_id") == []
    # Rows that arrive late make their day due again.
    spark.read.parquet(path).where("day = '2024-01-02'").limit(1).write.mode("append").partitionBy("day").parquet(path)
    assert S.compact(spark, path, start + dt.timedelta(days=11), segment="phase_id") == [dt.date(2024, 1, 2)]


@pytest.fixture(scope="module")
def fleet_store(spark):
    base, first = work_dir(spark, "fleet"), dt.date(2024, 6, 10)
    thin = F.unix_seconds("time") % 60 == 0
    fleet.inverter_samples(spark, 2, first, 2).where(thin).write.partitionBy("day").parquet(f"{base}/inverter_samples")
    fleet.meter_samples(spark, 2, first, 2).where(thin).write.partitionBy("day").parquet(f"{base}/meter_samples")
    fleet.registry(spark, 2).write.parquet(f"{base}/device_registry")
    fleet.site_numbers(spark, 2).drop("scenario").write.parquet(f"{base}/site")
    return base


def test_reading_a_range_prunes_partitions(spark, fleet_store):
    df = T.read_samples(spark, fleet_store, "meter_samples", dt.datetime(2024, 6, 10, 3), dt.datetime(2024, 6, 11))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(time), GreaterThanOrEqual(time" in plan
    assert {r.day for r in df.select("day").distinct().collect()} == {dt.date(2024, 6, 10)}
    local = T.read_local_days(spark, fleet_store, "meter_samples", dt.date(2024, 6, 10), dt.date(2024, 6, 10), fleet.TZ)
    bounds = local.agg(F.min("time"), F.max("time")).first()
    assert bounds[0] == dt.datetime(2024, 6, 9, 22) and bounds[1] == dt.datetime(2024, 6, 10, 21, 59)
    assert "1970" not in local._jdf.queryExecution().executedPlan().toString()


def test_rollup_of_a_store_can_be_repeated(spark, fleet_store):
    first, last = dt.date(2024, 6, 10), dt.date(2024, 6, 11)
    tables = ("power_30sec", "power_5min", "inverter_daily", "meter_daily", "site_energy")

    def read():
        return {t: sorted(map(str, T.read_table(spark, fleet_store, t).collect())) for t in tables}

    run_site_rollup(spark, fleet_store, first, last, fleet.TZ)
    once = read()
    assert [len(once[t]) for t in tables[2:]] == [8, 8, 4]
    run_site_rollup(spark, fleet_store, last, last, fleet.TZ)
    assert read() == once
    refresh_power(spark, fleet_store, first, first, fleet.TZ)
    assert read() == once


def folder_files(path):
    import pathlib

    return sorted(str(p.relative_to(path)) for p in pathlib.Path(path).rglob("*.parquet"))


def test_upsert_reads_only_the_touched_days(spark):
    path = work_dir(spark, "pruned")
    S.upsert_days(spark, daily(spark, [("a", d, d) for d in range(1, 29)]), path)
    text = S.stored_rows(spark, path, daily(spark, [("a", 0, 3)]), KEY)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "2024-01-03" in text.split("PartitionFilters: ")[1].split("]")[0]
    before = set(folder_files(path))
    S.upsert_days(spark, daily(spark, [("b", 9, 3)]), path)
    changed = {f.split("/")[0] for f in before ^ set(folder_files(path))}
    assert changed == {"day=2024-01-03"}


class Died(Exception):
    pass


@pytest.mark.parametrize("stop", ["staging", "committed", "new files moved in", "one old file gone"])
def test_a_rewrite_that_dies_loses_nothing(spark, monkeypatch, stop):
    path = f"{work_dir(spark, 'crash')}/t"
    S.upsert_days(spark, daily(spark, [("a", 1, 1), ("b", 2, 1), ("c", 3, 2)]), path)
    change = daily(spark, [("a", 9, 1), ("d", 4, 2)])
    real_finish, real_move, calls = S._finish, S.move_days, []

    def finish(spark_, path_):
        calls.append(1)
        if stop == "committed" and len(calls) == 2:
            raise Died
        return real_finish(spark_, path_)

    def move(spark_, source, target):
        real_move(spark_, source, target)
        if stop == "one old file gone":
            fs, _ = S._fs(spark_, target)
            fs.delete(S._fs(spark_, f"{target}/{S.read_small(spark_, f'{source}/{S.REPLACED}').split()[0]}")[1], False)
        raise Died

    if stop == "staging":
        monkeypatch.setattr(S, "rows_by_day", lambda df, real=S.rows_by_day: real(df) if not calls.append(1) and len(calls) == 1 else
                            (_ for _ in ()).throw(Died()))
    elif stop == "committed":
        monkeypatch.setattr(S, "_finish", finish)
    else:
        monkeypatch.setattr(S, "move_days", move)
    with pytest.raises(Died):
        S.upsert_days(spark, change, path)
    monkeypatch.undo()
    if stop != "staging":
        assert S.recover(spark, path)
        assert not S.recover(spark, path)
    else:
        assert content(spark, path) == [("a", 1, 1), ("b", 2, 1), ("c", 3, 2)]
    S.upsert_days(spark, change, path)
    assert content(spark, path) == [("a", 9, 1), ("b", 2, 1), ("c", 3, 2), ("d", 4, 2)]


def test_staged_files_that_were_lost_are_not_committed(spark, monkeypatch):
    path = f"{work_dir(spark, 'lost')}/t"
    S.append_days(daily(spark, [("a", i, 1 + i % 3) for i in range(30)]), path)
    before, real = content(spark, path), S.rows_by_day

    def lose(df):
        counted = real(df)
        for name in S.names_in(spark, path):
            if name.startswith(S.STAGING):
                counted = dict(list(counted.items())[1:])   # as if a day's files were gone
        return counted

    monkeypatch.setattr(S, "rows_by_day", lose)
    for rewrite in (lambda: S.compact(spark, path, dt.datetime(2024, 3, 1), time="day"),
                    lambda: S.upsert_days(spark, daily(spark, [("b", 1, 1), ("b", 1, 2)]), path)):
        with pytest.raises(OSError, match="not complete"):
            rewrite()
        assert content(spark, path) == before and not [n for n in S.names_in(spark, path) if n.startswith((S.STAGING, S.PENDING))]
    monkeypatch.undo()
    # A staging folder that somebody removes takes its list along.
    real_commit = S._commit
    monkeypatch.setattr(S, "_commit", lambda s, p, lease, write, *rest: real_commit(
        s, p, lease, lambda at: (S.drop_folder(s, at), write(at)), *rest))
    with pytest.raises(OSError, match="not complete"):
        S.compact(spark, path, dt.datetime(2024, 3, 1), time="day")
    assert content(spark, path) == before


@pytest.mark.parametrize("when", ["while staging", "between staging and commit", "while publishing"])
@pytest.mark.parametrize("rewrite", ["compact", "upsert"])
def test_rows_that_come_next_to_a_rewrite_stay(spark, monkeypatch, when, rewrite):
    base = work_dir(spark, "race")
    path = f"{base}/t"
    old = [(f"d{i}", i, 1 + i % 2) for i in range(10)]
    S.append_days(daily(spark, old), path)

    def arrive():
        S.insert_first(spark, daily(spark, [("e", 5, 1), ("d0", 99, 1)]), path, KEY)    # d0 is stored already
        with pytest.raises(S_lease.TableBusy):
            S.upsert_days(spark, daily(spark, [("x", 1, 1)]), path, wait=0)

    from sunledger.sources import lease as S_lease

    if when == "while staging":
        real = S._commit
        monkeypatch.setattr(S, "_commit", lambda s, p, lease, write, *rest: real(s, p, lease, lambda at: (arrive(), write(at), arrive()), *rest))
    elif when == "between staging and commit":
        monkeypatch.setattr(S_lease.Lease, "check", lambda self: arrive())
    else:
        real = S.move_days

        def move(s, source, target):
            arrive()
            real(s, source, target)
            arrive()

        monkeypatch.setattr(S, "move_days", move)
    if rewrite == "compact":
        assert S.compact(spark, path, dt.datetime(2024, 3, 1), time="day") == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
        want = [*old, ("e", 5, 1)]
    else:
        S.upsert_days(spark, daily(spark, [("d0", 7, 1), ("n", 8, 2)]), path)
        want = [("d0", 7, 1), *old[1:], ("n", 8, 2), ("e", 5, 1)]
    assert content(spark, path) == sorted(want)


def test_two_threads_of_writers_lose_nothing(spark):
    """A compaction, an upsert and appends on one table, each in a loop of its own."""
    import threading

    path, errors = f"{work_dir(spark, 'threads')}/t", []
    S.append_days(daily(spark, [(f"d{i}", i, 1 + i % 3) for i in range(300)]), path)

    def run(job):
        try:
            for i in range(3):
                job(i)
        except Exception as err:
            errors.append(err)

    jobs = [lambda i: S.insert_first(spark, daily(spark, [(f"new{i}", i, 1 + i % 3)]), path, KEY),
            lambda i: S.compact(spark, path, dt.datetime(2024, 3, 1), time="day"),
            lambda i: S.upsert_days(spark, daily(spark, [(f"d{i}", 1000 + i, 1 + i % 3), (f"up{i}", i, 2)]), path)]
    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    # A read of keys may find a file gone; its writer repeats it.
    lost = [e for e in errors if "FILE_NOT_EXIST" not in str(e) and "does not exist" not in str(e)]
    assert not lost
    rows = {(d, v) for d, v, _ in content(spark, path)}
    assert {(f"d{i}", i) for i in range(3, 300)} <= rows and len(content(spark, path)) == len(rows)
    if not errors:
        assert rows == {(f"d{i}", i) for i in range(3, 300)} | {(f"d{i}", 1000 + i) for i in range(3)} | {
            (f"{n}{i}", i) for n in ("new", "up") for i in range(3)}


def test_an_expired_lease_is_taken_over_and_its_owner_cannot_commit(spark, monkeypatch):
    from sunledger.sources import lease as L

    path = f"{work_dir(spark, 'lease')}/t"
    with L.rewriting(spark, path) as first:
        with pytest.raises(L.TableBusy):
            with L.rewriting(spark, path, wait=0.3):
                pass
        first.check()
    with L.rewriting(spark, path, ttl=600) as first:    # dead: nobody renews it
        fs, hpath = S._fs(spark, L.lease_file(path))
        fs.setTimes(hpath, 1_000_000, -1)
        with L.rewriting(spark, path, wait=5) as second:
            second.check()
            with pytest.raises(L.LeaseLost):
                first.check()
            with pytest.raises(L.LeaseLost):
                first.renew()
    assert S.names_in(spark, path.rpartition("/")[0]) == []


def test_readers_wait_for_a_replacement_to_be_published(spark, monkeypatch):
    base = work_dir(spark, "reader")
    path = T.table_path(base, "meter_daily")
    row = {f.name: None for f in T.TABLES["meter_daily"]}

    def rows(n):
        return spark.createDataFrame([{**row, "site_id": "S", "device_name": "m", "sample_count": n, "day": dt.date(2024, 1, 1)}], T.TABLES["meter_daily"])

    S.upsert_days(spark, rows(1), path)
    real, seen = S.move_days, []

    def move(s, source, target):
        real(s, source, target)
        monkeypatch.setattr(T, "PATIENCE", 0.0)
        with pytest.raises(T.TableBusy):
            T.read_table(spark, base, "meter_daily")
        seen.append(spark.read.parquet(target).count())

    monkeypatch.setattr(S, "move_days", move)
    S.upsert_days(spark, rows(2), path)
    assert seen == [2]  # both are there for a moment; read_table shows neither
    assert [r.sample_count for r in T.read_table(spark, base, "meter_daily").collect()] == [2]


def test_a_backlog_is_compacted_in_groups_of_days(spark, monkeypatch):
    path, commits = f"{work_dir(spark, 'backlog')}/t", []
    S.append_days(daily(spark, [("a", i, i) for i in range(1, 8)]), path)
    real = S._commit
    monkeypatch.setattr(S, "DAYS_PER_COMMIT", 3)
    monkeypatch.setattr(S, "_commit", lambda s, p, lease, write, replaced, *rest: (
        commits.append(len({r.split("/")[0] for r in replaced})), real(s, p, lease, write, replaced, *rest)))
    assert len(S.compact(spark, path, dt.datetime(2024, 3, 1), time="day")) == 7 and commits == [3, 3, 1]
    assert S.compact(spark, path, dt.datetime(2024, 3, 1), time="day") == [] and len(content(spark, path)) == 7


def test_whole_store_compaction_clusters_by_segment(spark):
    base = work_dir(spark, "whole")
    for table, ident in (("inverter_phase_samples", "phase_id"), ("inverter_input_samples", "input_id"), ("meter_samples", None)):
        rows = spark.range(400).select(
            F.lit("S").alias("site_id"), F.concat(F.lit("d"), F.col("id") % 4).alias("device_name"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 200).alias("time"),
            *([(F.col("id") % 2 + 1).cast("short").alias(ident)] if ident else []))
        full = rows.withColumn("day", F.to_date("time"))
        missing = [f for f in T.TABLES[table] if f.name not in full.columns]
        S.append_days(full.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in missing)).select(
            T.TABLES[table].fieldNames()).repartition(3), T.table_path(base, table))
    before = {t: sorted(map(str, T.read_table(spark, base, t).collect())) for t in ("inverter_phase_samples", "meter_samples")}
    done = S.apply_compaction(spark, base, dt.datetime(2024, 3, 1))
    assert set(done) == {"inverter_phase_samples", "inverter_input_samples", "meter_samples"} and all(len(d) == 1 for d in done.values())
    assert before == {t: sorted(map(str, T.read_table(spark, base, t).collect())) for t in before}
    one = spark.read.parquet(f"{T.table_path(base, 'inverter_phase_samples')}/day=2024-01-01").select("phase_id", "device_name", "time").collect()
    assert one == sorted(one, key=lambda r: (r.phase_id, r.device_name, -r.time.timestamp()))
    assert all(d == [] for d in S.apply_compaction(spark, base, dt.datetime(2024, 3, 1)).values())
