"""The commit log, the journal, runs in parts and the pre-aggregate kept up to date."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from gridtally.operators import grid, reconcile
from gridtally.operators.reconcile import SourceConfig
from gridtally.sources import state
from gridtally.sources.journal import Journal, latest_run
from gridtally.sources.schema import SOURCE_RECORD
from gridtally.sources.state import Change, Conflict, SnapshotStore
from gridtally.streaming import incremental, jobs, resumable
from tests.test_ingestion import raw, record, states

DAY = dt.datetime(2024, 1, 1)
SHAPE = "id string, v int"


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SHAPE)


WRITER = """
import sys
from pyspark.sql import SparkSession
from gridtally.sources.state import Change, SnapshotStore
root, name, n = sys.argv[1], sys.argv[2], int(sys.argv[3])
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
store = SnapshotStore(spark, root)
for i in range(n):
    df = spark.sql(f"SELECT '{name}-{i}' AS id, {i} AS v").coalesce(1)
    total = lambda pointer: pointer["config"].get("total", 0) + 1
    store.transact(lambda p: Change(appended={"t": df}, merged={"m": (df, ["id"])}, config={"total": total(p)}))
"""


def test_two_processes_keep_all_commits(spark, store):
    env = os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"}
    writers = [
        subprocess.Popen([sys.executable, "-c", WRITER, store.root, name, "50"], env=env, stderr=subprocess.PIPE)
        for name in "ab"
    ]
    errors = [w.communicate(timeout=600)[1].decode() for w in writers]
    assert [w.returncode for w in writers] == [0, 0], errors
    wanted = {f"{name}-{i}" for name in "ab" for i in range(50)}
    pointer = store.pointer()
    assert pointer["config"]["total"] == 100
    for name in "tm":
        found = [r["id"] for r in store.read(name, pointer).collect()]
        assert sorted(found) == sorted(wanted)
    assert len(pointer["tables"]["t"]) <= 2 * state.MOST_DELTAS
    plan = store.read("t", pointer)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_conflicts_by_table(spark, store):
    store.commit({"a": rows(spark, ("x", 1)), "b": rows(spark, ("x", 1))}, config={"k": 1})
    base = store.pointer()
    store.commit(appended={"log": rows(spark, ("x", 1))}, config={"other": 1})
    store.commit({"b": rows(spark, ("y", 2))}, base=base)  # nothing that it was made from has changed
    with pytest.raises(Conflict, match="b was committed by another writer"):
        store.commit({"b": rows(spark, ("z", 3))}, base=base)
    with pytest.raises(Conflict, match="b"):
        store.commit({"a": rows(spark, ("z", 3))}, base=base, reads=["b"])
    with pytest.raises(Conflict, match="other"):
        store.commit(config={"other": 2}, base=base)
    store.commit(appended={"log": rows(spark, ("y", 1))}, base=base)
    assert store.read("log").count() == 2 and store.read("b").first()["v"] == 2
    known = store.pointer()
    for key in "pq":
        store.commit(merged={"m": (rows(spark, (key, 1)), ["id"])}, rows={"m": [key]}, base=known)
    with pytest.raises(Conflict, match="m"):
        store.commit(merged={"m": (rows(spark, ("q", 2)), ["id"])}, rows={"m": ["q"]}, base=known)
    assert {r["id"] for r in store.read("m").collect()} == {"p", "q"}


def test_a_number_is_taken_once(spark, store):
    store.commit({"t": rows(spark, ("x", 1))})
    path = f"{store.root}/log/0000000001.json"
    before = store._read_text(path)
    assert not store._put_if_absent(path, "other") and store._read_text(path) == before
    assert [n for n in store._names(store._log) if n.startswith(".")] == []


def test_log_is_folded_and_cut(spark, store):
    for n in range(23):
        store.commit({"t": rows(spark, ("x", n))}, config={"n": n, "gone": 1 if n < 20 else None})
    assert "0000000020.state" in store._names(store._log)
    pointer = store.pointer()
    assert pointer["version"] == 23 and pointer["config"] == {"n": 22}
    with store.staging() as stage:
        stage(rows(spark, ("x", 1)), "left")
        assert store.vacuum(dt.timedelta(hours=1)) == 0
    assert store.vacuum(dt.timedelta(0)) == 22
    assert store._names(store._log)[0] == "0000000020.state" and store.pointer() == pointer
    store.commit({}, config={"n": 23})
    assert store.pointer()["version"] == 24 and store.read("t").first()["v"] == 22
    store.commit(dropped=["t"])
    assert store.read("t") is None


def test_killed_run_is_told(spark, store):
    now = [DAY]
    journal = Journal(store, "demo", lambda: now[0], dt.timedelta(hours=1))
    journal.start("r1")
    status = lambda: {r["run_id"]: r["status"] for r in store.read("runs").collect()}
    assert status() == {"r1": "running"}
    now[0] += dt.timedelta(minutes=30)
    with pytest.raises(RuntimeError, match="r1 of demo is under way"):
        incremental.ingest_batch(store, raw(spark, record(1)), SourceConfig("demo"), "r2", DAY, journal=journal)
    now[0] += dt.timedelta(hours=2)
    incremental.ingest_batch(store, raw(spark, record(1)), SourceConfig("demo"), "r2", DAY, complete=True, journal=journal)
    assert status() == {"r1": "failed", "r2": "completed"}
    with pytest.raises(RuntimeError, match="r1 was given up"):
        journal.closing(store.pointer(), {"run_id": "r1"})
    last = latest_run(store.read("runs"), "demo").first()
    assert last["started_at"] == now[0] and last["completed_at"] == now[0]
    lost = store.read("runs").where("run_id = 'r1'").first()
    assert lost["error_message"].startswith("no sign of life") and lost["started_at"] == DAY


def test_run_times_are_the_clocks(spark, store):
    run = incremental.full_run(store, raw(spark, record(1)), SourceConfig("demo"), "r1", DAY)
    row = latest_run(store.read("runs"), "demo").first()
    assert run["status"] == "completed" and row["started_at"] > DAY + dt.timedelta(days=300)
    assert row["completed_at"] > row["started_at"] and states(store)["1"]["first_seen_at"] == DAY


class Killed(BaseException):
    pass


def test_stopped_run_goes_on(spark, store, tmp_path):
    """Stopped after the second of its parts, with a record changed meanwhile in one it had done."""
    config = SourceConfig("demo", most_drop_percent=80.0)
    first = raw(spark, *(record(i) for i in range(40)))
    second = [record(i, kind="ARSON" if i % 7 == 0 else "THEFT") for i in range(60) if i % 10]
    second += [record("x1"), record(5), {**record(1), "id": None}]
    other = SnapshotStore(spark, str(tmp_path / "other"))
    for s in (store, other):
        incremental.full_run(s, first, config, "r1", DAY)

    def stop(part):
        if part == 1:
            raise Killed

    later = DAY + dt.timedelta(days=1)
    with pytest.raises(Killed):
        resumable.complete_in_parts(store, raw(spark, *second), config, "r2", later, part_records=15, after_part=stop)
    held = store.pointer()["config"]["progress:demo"]
    assert held["done"] == 2 and len(held["bounds"]) == 3
    assert states(store)["0"]["removal_confidence"] == "none"  # no absence before the end
    done = []
    run = resumable.complete_in_parts(
        store, raw(spark, *second), config, "r3", later + dt.timedelta(days=9), after_part=done.append
    )
    whole = incremental.full_run(other, raw(spark, *second), config, "r2", later)
    assert done == [2, 3] and run["run_id"] == "r2" and run["records_missing"] == 4
    assert {k: run.get(k) for k in whole} == whole
    for name in ("source_records", "incidents", "offenses", "versions"):
        mine, theirs = (sorted(map(repr, s.read(name).collect())) for s in (store, other))
        assert mine == theirs
    after = store.pointer()
    assert "progress:demo" not in after["config"] and "seen-demo" not in after["tables"]
    assert after["config"]["baseline:demo"] == other.pointer()["config"]["baseline:demo"]


def test_ranges_cover_all(spark):
    records = raw(spark, *(record(i) for i in [1, 2, 3, 500, 501, 10**12, -4, "abc"]), {**record(9), "id": None})
    bounds = resumable.plan_ranges(records, 3)
    parts = [resumable.in_range(records, bounds, i).count() for i in range(len(bounds) + 1)]
    assert len(parts) == 3 and sum(parts) == 9 and max(parts) < 6
    assert resumable.plan_ranges(records.limit(0), 3) == []


def placed(i, kind="THEFT", **more):
    at = {"latitude": f"41.{i % 7}1", "longitude": f"-87.6{i % 9}", "date": f"2023-0{1 + i % 9}-03T10:00:00"}
    return record(i, kind=kind, **(at | more))


def test_preaggregate_follows_increments(spark, store):
    config = SourceConfig("demo")
    jobs.save_config(store, config)
    jobs.complete_run(store, raw(spark, *(placed(i) for i in range(60))), "demo", "r1", DAY, confirm=True)
    parts = len(store.pointer()["tables"]["rollup"])
    steps = [
        [placed(i, "ARSON") for i in range(0, 60, 5)],  # offenses change their category
        [placed(i) for i in range(60, 75)] + [placed(80, case_number="C3")],  # new ones, one in an old case
        [placed(i, date="2022-12-01T00:00:00", latitude="42.0") for i in range(3, 9)] + [placed(90, latitude="")],
        [placed(i, longitude=f"-87.6{i % 9}01") for i in range(20, 30)],  # moved within their cells
    ]
    for n, step in enumerate(steps):
        policy = "latest_wins" if n >= 2 else "first_wins"
        incremental.ingest_batch(store, raw(spark, *step), config, f"i{n}", DAY, incident_policy=policy)
        pointer = store.pointer()
        kept = grid.added_up(store.read("rollup", pointer))
        anew = grid.rollup_parts(store.read("incidents", pointer), store.read("offenses", pointer))
        columns = grid.ROLLUP_KEY + grid.MEASURES
        mine, theirs = (sorted(map(repr, df.select(*columns).collect())) for df in (kept, anew))
        assert mine == theirs and len(pointer["tables"]["rollup"]) == parts + n + 1
    last = spark.read.parquet(pointer["tables"]["rollup"][-1])
    assert 0 < last.count() < anew.count() / 2 and last.where("n < 0").count() > 0
    assert store.read("incidents").where(F.col("lat") == 42.0).count() == 6


def told():
    return 7


def test_a_source_is_asked_for_its_count(spark, store):
    jobs.save_config(store, SourceConfig("demo"))
    run = jobs.complete_run(
        store, raw(spark, record(1)), "demo", "r1", DAY, confirm=True, total=f"{__name__}:told"
    )
    assert run["blocking_reason"] == "source_count_mismatch"
    assert jobs.load_config(store, "demo").watermark is None


def test_joined_parts(spark, store, monkeypatch):
    monkeypatch.setattr(state, "MOST_DELTAS", 3)
    for n in range(30):
        store.commit(appended={"t": rows(spark, (f"r{n}", n))})
        assert {r["v"] for r in store.read("t").collect()} == set(range(n + 1))
    assert len(store.pointer()["tables"]["t"]) <= 6
    assert Change().tables == {}


def test_records_meet_state_in_one_join(spark):
    """The last of each record is not moved again to meet its state, and all is made of what met."""
    schema = "external_record_id string, fingerprint string, at int"
    fetched = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1), ("d", "1", 1)], schema)
    held = [("demo", k, True, DAY, DAY, None, "none", 0, "1") for k in "abc"]
    state = spark.createDataFrame(held, SOURCE_RECORD)
    last = reconcile.dedupe_last(fetched, "external_record_id", F.col("at"))
    rows = reconcile.met(last, state, True).hint("merge")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    kinds = {r["external_record_id"]: r["kind"] for r in rows.collect()}
    assert kinds == {"a": "changed", "b": "unchanged", "c": None, "d": "created"}
    after = reconcile.state_after(rows, "demo", DAY, True)
    theirs = reconcile.merge_state(state, last, "demo", DAY, True)
    assert sorted(map(repr, after.collect())) == sorted(map(repr, theirs.select(*after.columns).collect()))


def test_read_of_columns_and_keys(spark, store):
    """Columns and a condition on the key leave the merged table's rows as they are."""
    form = "k string, n int, more string"
    for n, keys in enumerate(("abc", "bd", "c")):
        store.commit(merged={"t": (spark.createDataFrame([(k, n, f"{k}{n}") for k in keys], form), ["k"])})
    whole = {(r["k"], r["n"]) for r in store.read("t").collect()}
    assert whole == {("a", 0), ("b", 1), ("c", 2), ("d", 1)}
    assert {tuple(r) for r in store.read("t", columns=["k", "n"]).collect()} == whole
    assert {r["n"] for r in store.read("t", columns=["n"], where=F.col("k") >= "c").collect()} == {2, 1}
    assert store.read("t", columns=["n"]).columns == ["n"]
    assert store.read("t", columns=["k"]).count() == 4


def test_absence_where_another_run_came_between(spark, store):
    config = SourceConfig("demo", most_drop_percent=90.0)
    incremental.full_run(store, raw(spark, *(record(i) for i in range(8))), config, "r1", DAY)
    second = raw(spark, *(record(i) for i in range(8) if i % 3))

    def stop(part):
        raise Killed

    with pytest.raises(Killed):
        resumable.complete_in_parts(store, second, config, "r2", DAY, part_records=3, after_part=stop)
    incremental.full_run(store, raw(spark, record(3)), SourceConfig("other"), "o1", DAY)
    run = resumable.complete_in_parts(store, second, config, "r3", DAY)
    assert run["records_missing"] == 3
    found = store.read("source_records").where("source_id = 'demo' AND consecutive_missing_runs = 1")
    assert {r["external_record_id"] for r in found.collect()} == {"0", "3", "6"}
