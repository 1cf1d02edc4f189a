"""Jobs and answers over a small store, from bootstrap to map."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridtally.operators import listing
from gridtally.operators.filters import Filters
from gridtally.operators.reconcile import SourceConfig, held
from gridtally.plans.serving import Answers, Service
from gridtally.sources.state import SnapshotStore
from gridtally.streaming import jobs
from tests.test_ingestion import raw, record

NOW = dt.datetime(2024, 1, 1)


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def placed(i, **more):
    return record(i, latitude="41.81", longitude=f"-87.6{i}", community_area=str(i % 2), **more)


def test_from_bootstrap_to_map(spark, store):
    with pytest.raises(ValueError):
        jobs.load_config(store, "demo")
    jobs.save_config(store, SourceConfig("demo", most_drop_percent=90.0))
    everything = raw(spark, *(placed(i, kind="ARSON" if i == 3 else "THEFT") for i in range(1, 6)))
    with pytest.raises(ValueError):
        jobs.complete_run(store, everything, "demo", "r0", NOW)
    with pytest.raises(ValueError):
        jobs.incremental_run(store, everything, "demo", "r0", NOW)
    with pytest.raises(ValueError):
        jobs.checked_fetch(everything.drop("iucr"))
    sampled = jobs.sample_run(store, everything, "demo", "r1", NOW, 2)
    assert sampled["status"] == "partial" and store.read("incidents").count() == 2
    run = jobs.complete_run(store, everything, "demo", "r2", NOW, reported=5, confirm=True)
    assert run["records_created"] == 3 and jobs.load_config(store, "demo").watermark == NOW
    later = raw(spark, placed(6, updated_on="2024-01-01T05:00:00"), placed(7, updated_on="2023-12-01T00:00:00"))
    run = jobs.incremental_run(store, later, "demo", "r3", NOW + dt.timedelta(days=1))
    assert run["records_received"] == 1 and store.read("incidents").count() == 6

    service = Service(spark, store, spark.createDataFrame([("1", "One")], "code string, name string"))
    page = service.incidents(limit=4)
    assert page["total"] == 6 and len(page["items"]) == 4 and len(page["items"][0]["offenses"]) == 1
    cells = service.aggregate(9)
    assert cells["source"] == "rollup" and sum(c["incident_count"] for c in cells["cells"]) == 6
    assert service.aggregate(9) is cells
    assert service.aggregate(15)["source"] == "raw"
    assert service.categories() == ["ARSON", "THEFT"]
    shown = service.summary(Filters(source_id="demo"))
    assert shown["current"] == 6 and shown["most_common_category"] == "THEFT"
    status = service.status()[0]
    assert status["incident_count"] == 6 and status["is_complete"]
    jobs.refresh_rollup(store)
    assert service.aggregate(9) is not cells  # a new version is a new question

    history = listing.version_history(store.read("versions"))
    assert listing.lookup(history, external_record_id="6").first()["history"][0]["run_id"] == "r3"
    assert listing.active_records(store.read("source_records"), "demo").count() == 6


def test_merged_tables(spark, store, monkeypatch):
    from gridtally.sources import state

    monkeypatch.setattr(state, "MOST_DELTAS", 3)
    shape = "id string, v int"
    for n in range(7):
        rows = [("same", n), (f"own{n}", n), ("gone", None if n == 5 else 0)]
        store.commit(merged={"t": (spark.createDataFrame(rows, shape), ["id"])})
        held = {r["id"]: r["v"] for r in store.read("t").collect()}
        assert held["same"] == n and len(held) == n + 3
        assert held["gone"] == (None if n == 5 else 0)
        assert len(store.pointer()["tables"]["t"]) <= 3
    store.commit({"t": spark.createDataFrame([("one", 1)], shape)})
    assert store.read("t").columns == ["id", "v"] and store.read("t").count() == 1


def test_filters_reach_the_base_after_an_increment(spark, store):
    shape = "id string, v int, w int"
    store.commit(merged={"t": (spark.createDataFrame([(str(i), i, i) for i in range(50)], shape), ["id"])})
    store.commit(merged={"t": (spark.createDataFrame([("7", 70, 0), ("99", 99, 0)], shape), ["id"])})
    store.commit(merged={"t": (spark.createDataFrame([("7", 71, 0)], shape), ["id"])})
    asked = store.read("t").where("v > 45").select("id", "v")
    assert {tuple(r) for r in asked.collect()} == {*((str(i), i) for i in range(46, 50)), ("7", 71), ("99", 99)}
    plan = asked._jdf.queryExecution().executedPlan().toString()
    base = next(x for x in plan.splitlines() if "FileScan" in x and "GreaterThan(v,45)" in x)
    assert "w" not in base.split("ReadSchema:")[1]


def test_two_writers_lose_nothing(spark, store, monkeypatch):
    one = spark.createDataFrame([("a", 1)], "id string, v int")
    store.commit({"t": one})
    stale = store.pointer() | {"version": 0}
    real, seen = store.pointer, []
    monkeypatch.setattr(store, "pointer", lambda: real() if seen else seen.append(1) or stale)
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit({"t": one.withColumn("v", F.lit(2))})
    assert store.read("t").first()["v"] == 1


def test_vacuum_keeps_the_current_version(spark, store):
    for n in range(3):
        store.commit({"t": spark.createDataFrame([("a", n)], "id string, v int")})
    assert store.vacuum() == 0  # a folder this young may be another writer's
    assert store.vacuum(dt.timedelta(0)) == 2 and store.vacuum(dt.timedelta(0)) == 0
    assert store.read("t").first()["v"] == 2


def test_hold_stops_evidence(spark, store):
    jobs.save_config(store, held(SourceConfig("demo")))
    run = jobs.complete_run(store, raw(spark, record(1)), "demo", "r1", NOW, confirm=True)
    assert run["blocking_reason"] == "manual_safety_hold"
    assert jobs.load_config(store, "demo").watermark is None


def test_reference_codes(spark, store):
    codes = "code string, name string"
    assert jobs.refresh_reference(store, spark.createDataFrame([("1", "a"), ("2", "b")], codes), "code") == 2
    assert jobs.refresh_reference(store, spark.createDataFrame([("2", "c")], codes), "code") == 2
    assert store.read("codes").where(F.col("name") == "c").count() == 1


def test_empty_store(spark, store):
    service = Service(spark, store)
    assert service.status() == [] and service.categories() == []
    assert service.incidents()["total"] == 0 and service.aggregate(3)["cells"] == []
    assert service.summary(Filters(), today=dt.date(2024, 1, 1))["current"] == 0
    assert jobs.refresh_rollup(store) is None and service.health() == {"status": "ok"}


def test_answers_age_and_go():
    now = [0.0]
    cache = Answers(10, 2, lambda: now[0])
    made = []
    for key, at in (("a", 0), ("a", 9), ("a", 11), ("b", 12), ("c", 12), ("a", 12)):
        now[0] = at
        cache.get(key, lambda key=key: made.append(key) or {})
    assert made == ["a", "a", "b", "c", "a"]
