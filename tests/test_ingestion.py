"""Normalising, reconciling, storing and streaming raw records."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridtally.operators import reconcile as rec
from gridtally.sources import normalize as nz
from gridtally.sources import paged
from gridtally.sources.paged import PagedSource
from gridtally.sources.schema import CITY_CONTRACT, RAW, RUN, SOURCE_RECORD, check_schema
from gridtally.sources.journal import latest_run
from gridtally.sources.state import SnapshotStore
from gridtally.streaming import incremental

DAY = dt.datetime(2024, 1, 1)


def raw(spark, *rows):
    base = {"date": "2023-07-01T12:00:00.000", "updated_on": "2023-07-02T00:00:00", "iucr": "0110"}
    return spark.createDataFrame([tuple((base | r).get(n) for n in RAW.names) for r in rows], RAW)


def record(i, case=None, kind="THEFT", **more):
    return {"id": str(i), "case_number": case or f"C{i}", "primary_type": kind, **more}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2023-07-01T12:00:00.000", "2023-07-01 17:00:00"),
        ("2023-01-01T12:00:00", "2023-01-01 18:00:00"),
        ("2023-11-05T01:30:00.000", "2023-11-05 06:30:00"),
        ("2023-11-05T02:30:00.000", "2023-11-05 08:30:00"),
        ("2023-02-30T00:00:00", None),
        ("yesterday", None),
        (None, None),
    ],
)
def test_local_times(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    shown = df.select(F.date_format(nz.local_to_utc(F.col("t")), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert shown == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2023-11-05T00:30:00", "2023-11-05 05:30:00"),
        ("2023-11-05T01:30:00", "2023-11-05 07:30:00"),
        ("2023-11-04T02:30:00", "2023-11-04 07:30:00"),
        ("2023-11-05T02:30:00", "2023-11-05 08:30:00"),
        ("2024-03-10T02:30:00", "2024-03-10 08:30:00"),
        ("2024-03-09T02:30:00", "2024-03-09 08:30:00"),
        ("bad", None),
    ],
)
def test_last_of_repeated_times(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    utc = nz.local_to_utc(F.col("t"), repeated="last")
    assert df.select(F.date_format(utc, "yyyy-MM-dd HH:mm:ss")).first()[0] == expected


def test_normalise(spark):
    rows = raw(
        spark,
        record(1, "A", "HOMICIDE", latitude="41.5", longitude="-87.5", community_area="3"),
        record(2, "A", "HOMICIDE", latitude="", longitude="x"),
        record(3, "B"),
    )
    incidents, offenses = nz.normalize(rows, "demo")
    found = {r["external_incident_id"]: r for r in incidents.collect()}
    assert set(found) == {"A", "B"} and offenses.count() == 3
    assert found["A"]["lat"] == 41.5 and found["A"]["location_precision"] == "block"
    assert found["B"]["location_precision"] == "unknown"
    counts = {r["external_offense_id"]: r["victim_count"] for r in offenses.collect()}
    assert counts == {"1": 1, "2": 1, "3": None}
    again = {r["id"] for r in nz.normalize(rows, "demo")[0].collect()}
    assert again == {r["id"] for r in found.values()}


def test_fingerprint_laws(spark):
    def of(sql, fields=None):
        df = spark.sql(sql)
        return df.select(nz.fingerprint(df, fields)).first()[0]

    assert of("SELECT 1 AS a, 2 AS b") == of("SELECT 2 AS b, 1 AS a")
    assert of("SELECT 1 AS a, 2 AS b", ["a"]) == of("SELECT 1 AS a, 3 AS b", ["a"])
    assert of("SELECT 1 AS a, CAST(NULL AS STRING) AS b", ["a", "b"]) == of("SELECT 1 AS a", ["a", "b"])
    assert of("SELECT 1 AS a") != of("SELECT '1' AS a")
    assert of("SELECT 1 AS a", []) != of("SELECT 2 AS a", [])  # no fields named: all count


def test_schema_contract():
    offered = {f: "string" for f in CITY_CONTRACT.required} | {"arrest": "boolean", "novel": "string"}
    good = check_schema(offered, CITY_CONTRACT)
    assert good.valid and good.unknown == ("novel",)
    bad = check_schema({**offered, "arrest": "string"}, CITY_CONTRACT)
    assert not bad.valid and bad.retyped == ("arrest",)
    assert check_schema({}, CITY_CONTRACT).missing == tuple(sorted(CITY_CONTRACT.required))
    assert check_schema(RAW, CITY_CONTRACT).valid


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def states(store):
    return {r["external_record_id"]: r for r in store.read("source_records").collect()}


def test_life_of_records(spark, store):
    """Created, unchanged, changed, missing, confirmed gone, back again."""
    config = rec.SourceConfig("demo")
    days = [DAY + dt.timedelta(i) for i in range(5)]
    all_three = raw(spark, record(1), record(2), record(3))
    first = incremental.full_run(store, all_three, config, "r1", days[0])
    assert (first["records_created"], first["records_missing"]) == (3, 0)
    touched = raw(spark, record(1, updated_on="2024-01-01T00:00:00"), record(2, "C2", "ARSON"))
    second = incremental.full_run(store, touched, config, "r2", days[1])
    assert [second[f"records_{k}"] for k in ("created", "changed", "unchanged", "missing")] == [0, 1, 1, 1]
    assert states(store)["3"]["removal_confidence"] == "pending"
    partial = incremental.ingest_batch(store, raw(spark, record(1)), config, "r3", days[2])
    assert partial["plausibility_status"] == "not_evaluated"
    assert states(store)["3"]["consecutive_missing_runs"] == 1
    incremental.full_run(store, touched, config, "r4", days[3])
    gone = states(store)["3"]
    assert not gone["source_active"] and gone["removal_confidence"] == "confirmed"
    assert gone["source_removed_at"] == days[3]
    incremental.full_run(store, all_three, config, "r5", days[4])
    back = states(store)["3"]
    assert back["source_active"] and back["removal_confidence"] == "none"
    assert back["source_removed_at"] == days[3] and back["first_seen_at"] == days[0]
    versions = store.read("versions").groupBy("external_record_id").count().collect()
    assert {r[0]: r[1] for r in versions} == {"1": 1, "2": 3, "3": 1}
    offense = store.read("offenses").where("external_offense_id = '2'").first()
    assert offense["source_category"] == "THEFT"
    assert latest_run(store.read("runs"), "demo").first()["run_id"] == "r5"


def test_confidence_steps(spark):
    df = spark.createDataFrame([(n,) for n in range(5)], "n int")
    steps = [r[0] for r in df.select(rec.confidence(F.col("n"), 3)).collect()]
    assert steps == ["none", "pending", "likely", "confirmed", "confirmed"]


def test_suspicious_run_is_no_evidence(spark, store):
    config = rec.SourceConfig("demo", most_drop_percent=50.0)
    incremental.full_run(store, raw(spark, *(record(i) for i in range(10))), config, "r1", DAY)
    run = incremental.full_run(store, raw(spark, record(1)), config, "r2", DAY)
    assert run["blocking_reason"] == "record_count_drop_exceeds_threshold"
    assert run["records_missing"] == 0 and all(r["source_active"] for r in states(store).values())
    assert store.pointer()["config"]["baseline:demo"] == 10


def test_sources_do_not_meet(spark, store):
    both = raw(spark, record(1), record(2))
    incremental.full_run(store, both, rec.SourceConfig("a"), "r1", DAY)
    incremental.full_run(store, raw(spark, record(1)), rec.SourceConfig("b"), "r2", DAY)
    rows = store.read("source_records").collect()
    found = {(r["source_id"], r["external_record_id"]): r["consecutive_missing_runs"] for r in rows}
    assert found == {("a", "1"): 0, ("a", "2"): 0, ("b", "1"): 0}
    assert store.read("incidents").count() == 3


def test_hand_promotion():
    config = rec.SourceConfig("demo", 100)
    trusted, status = rec.promoted_by_hand(config, {"source_id": "demo", "records_received": 7})
    assert trusted.baseline == 7 and status == "overridden_trusted"
    with pytest.raises(ValueError):
        rec.promoted_by_hand(config, {"source_id": "other", "records_received": 7})
    assert rec.judge_run(rec.SourceConfig("s", 0, most_drop_percent=1.0), 5).evidence
    assert rec.judge_run(config, 1, schema_valid=False).reason == "schema_validation_failed"


def test_failed_run_keeps_old_tables(spark, store):
    config = rec.SourceConfig("demo")
    incremental.full_run(store, raw(spark, record(1)), config, "r1", DAY)
    broken = raw(spark, record(2)).withColumn("id", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        incremental.full_run(store, broken, config, "r2", DAY)
    assert set(states(store)) == {"1"}
    status = {r["run_id"]: r["status"] for r in store.read("runs").collect()}
    assert status == {"r1": "completed", "r2": "failed"}
    incremental.full_run(store, raw(spark, record(1), record(2)), config, "r3", DAY)
    assert set(states(store)) == {"1", "2"}


def test_source_is_read_once_and_null_ids_are_told(spark, store):
    config = rec.SourceConfig("demo")
    rows = raw(spark, record(1), record(2), record(1)).withColumn("block", F.expr("uuid()"))
    nameless = raw(spark, record(3)).withColumn("id", F.lit(None).cast("string"))
    run = incremental.full_run(store, rows.unionByName(nameless), config, "r1", DAY)
    assert (run["records_received"], run["error_message"]) == (2, "1 records without id left out")
    versions = {r["external_record_id"]: r["fingerprint"] for r in store.read("versions").collect()}
    assert versions == {k: r["current_fingerprint"] for k, r in states(store).items()}
    assert store.read("incidents").count() == store.read("offenses").count() == 2
    left = store._fs.listStatus(store._path(store.root))
    assert not [x for x in left if x.getPath().getName().startswith("stage-")]


def test_latest_run_of_equal_times(spark):
    rows = spark.createDataFrame(
        [("demo", r, "completed", DAY, DAY) for r in "bca"],
        "source_id string, run_id string, status string, started_at timestamp, completed_at timestamp",
    )
    assert latest_run(rows, "demo").first()["run_id"] == "c"


def test_latest_wins(spark):
    shape = "id string, v int"
    known = spark.createDataFrame([("a", 1), ("b", 1)], shape)
    found = spark.createDataFrame([("b", 2), ("c", 2)], shape)
    first = nz.insert_new_incidents(known, found)
    last = nz.insert_new_incidents(known, found, "latest_wins")
    assert {r["id"]: r["v"] for r in first.collect()} == {"a": 1, "b": 1, "c": 2}
    assert {r["id"]: r["v"] for r in last.collect()} == {"a": 1, "b": 2, "c": 2}
    with pytest.raises(ValueError):
        nz.insert_new_incidents(known, found, "any")


def test_stream_takes_each_file_once(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, *rows):
        (folder / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run():
        incremental.ingest_stream(
            spark, str(folder), RAW, store, rec.SourceConfig("demo"), str(tmp_path / "cp"), DAY
        )

    put("a.json", record(1), record(2))
    put("b.json", record(2, kind="ARSON"), record(3))
    run()
    run()
    assert set(states(store)) == {"1", "2", "3"} and store.read("runs").count() == 2
    assert store.read("incidents").count() == 3
    put("c.json", record(4))
    run()
    assert set(states(store)) == {"1", "2", "3", "4"}
    repeated = incremental.ingest_batch(
        store, raw(spark, record(9)), rec.SourceConfig("demo"), "again", DAY, stream=(f"demo@{folder}", 1)
    )
    assert repeated["status"] == "repeated" and "9" not in states(store)


def test_watermark_in_local_time(spark):
    rows = spark.sql("SELECT '1' AS id, TIMESTAMP '2024-01-01 05:30:00' AS updated_on")
    wm = dt.datetime(2024, 1, 1, 12)
    assert incremental.changed_since(rows, wm).count() == 0
    assert incremental.changed_since(rows, wm, zone="America/Chicago").count() == 1
    edge = dt.datetime(2024, 1, 1, 6, 30)
    assert incremental.changed_since(rows, edge).count() == 0
    assert incremental.changed_since(rows, edge, after_id="0").count() == 1


def test_ids_are_numbers(spark):
    rows = [tuple({"id": i, "case_number": "c", "block": f"b{i}"}.get(n) for n in RAW.names) for i in ("10", "x", "9")]
    incident = nz.normalize(spark.createDataFrame(rows, RAW), "demo")[0].first()
    assert incident["address_text"] == "b9"
    at = dt.datetime(2024, 1, 1)
    records = spark.createDataFrame([(i, at) for i in ("9", "10", "8")], "id string, updated_on timestamp")
    since = incremental.changed_since(records, at, "9", overlap=dt.timedelta(0))
    assert [r["id"] for r in since.collect()] == ["10"]


def test_requests_are_repeated_or_refused(monkeypatch):
    monkeypatch.setattr(paged, "PAUSE", 0)
    answers = []

    def ask(*errors):
        answers[:] = errors
        return paged.patient(lambda: answers.pop(0)() if answers else 7)

    def fail(error):
        def raised():
            raise error
        return raised

    assert ask(fail(paged.FetchError("busy", 429)), fail(paged.FetchError("down", 503)), fail(TimeoutError())) == 7
    with pytest.raises(paged.FetchError) as refused:
        ask(fail(paged.FetchError("no", 404)))
    assert refused.value.status == 404 and not answers
    with pytest.raises(paged.FetchError):
        ask(*[fail(ConnectionError("gone"))] * 4)


def areas(after, limit, low, high):
    return [{"code": str(i), "name": f"area {i}"} for i in range(23)][after : after + limit]


def described():
    return {"code": "string", "name": "string"}


def test_reference_table_by_offset(spark):
    spark.dataSource.register(PagedSource)
    here = f"{__name__}:"
    rows = (
        spark.read.format("gridtally_pages")
        .options(fetch=f"{here}areas", describe=f"{here}described", page="10")
        .load()
    )
    assert rows.columns == ["code", "name"] and rows.distinct().count() == 23


CALLS = []


def fetch(after, limit, low, high):
    """A stand-in for an API: ten records, and one lost connection."""
    CALLS.append(after)
    if len(CALLS) == 2:
        raise ConnectionError("once")
    rows = [{"id": f"{i:02d}", "v": i} for i in range(10)]
    return [r for r in rows if (not low or r["id"] >= low) and (not high or r["id"] < high) and (after is None or r["id"] > after)][:limit]


def test_paged_source(spark):
    options = {"fetch": f"{__name__}:fetch", "key": "id", "page": "2", "ranges": ":05,05:", "schema": "id string, v long"}
    from pyspark.sql.types import StructType

    source = PagedSource(options)
    reader = source.reader(StructType.fromDDL(source.schema()))
    got = [row for p in reader.partitions() for row in reader.read(p)]
    assert got == [(f"{i:02d}", i) for i in range(10)]


def test_schemas_name_their_columns():
    assert "removal_confidence" in SOURCE_RECORD.names and "run_id" in RUN.names
    assert rec.counters is not None
