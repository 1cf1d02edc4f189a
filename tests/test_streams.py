"""The stream of changes by compound cursor, and reconciliation as a keyed stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridtally.operators import reconcile as rec
from gridtally.sources import changes, paged
from gridtally.sources.changes import ChangeReader, OrderedApi, TableApi, change_stream, lay_out
from gridtally.sources.schema import RAW, SOURCE_RECORD
from gridtally.sources.state import SnapshotStore
from gridtally.streaming import incremental, keyed
from tests.test_ingestion import raw, record

DAY = dt.datetime(2024, 1, 1)
API = "gridtally.sources.changes:TableApi"


@pytest.fixture
def source(spark, tmp_path):
    """Records of three times, many of one, ids not in the order of their texts."""
    times = ["2024-01-01T00:00:00"] * 3 + ["2024-01-02T00:00:00"] * 25 + ["2024-01-03T00:00:00"] * 2
    rows = [record(i, updated_on=t, kind=f"K{i}") for i, t in enumerate(times, 1)]
    raw(spark, *rows).coalesce(1).write.parquet(str(tmp_path / "table"))
    (tmp_path / "limit").write_text("0")

    def let(n):
        (tmp_path / "limit").write_text(str(n))

    options = {"table": str(tmp_path / "table"), "limit": str(tmp_path / "limit"), "taskRows": "4", "pageRows": "3"}
    return options, let


def test_stream_stops_inside_one_time(spark, source, tmp_path):
    options, let = source
    store = SnapshotStore(spark, str(tmp_path / "store"))
    form = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW)
    received = []
    for n in (0, 2, 11, 11, 19, 30):  # 11 and 19 lie within the records of one time
        let(n)
        stream = change_stream(spark, API, form, **options)
        incremental.run_stream(stream, store, rec.SourceConfig("demo"), str(tmp_path / "cp"), "demo@api", DAY)
        runs = store.read("runs")
        received.append(0 if runs is None else runs.agg(F.sum("records_received")).first()[0])
    assert received == [0, 2, 11, 11, 19, 30]
    held = {r["external_record_id"] for r in store.read("source_records").collect()}
    assert held == {str(i) for i in range(1, 31)} and store.read("versions").count() == 30
    offsets = sorted((tmp_path / "cp" / "offsets").glob("[0-9]*"), key=lambda p: int(p.name))
    last = json.loads(offsets[-1].read_text().splitlines()[-1])
    assert last == {"updated_on": "2024-01-03T00:00:00", "id": "30"}


def test_stretches_cover_a_batch_by_count(source):
    options, let = source
    let(30)
    reader = ChangeReader({"api": API, **options}, RAW)
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    rows = [[r[RAW.names.index("id")] for r in reader.read(p)] for p in parts]
    assert [len(r) for r in rows] == [4] * 7 + [2] and sum(rows, []) == [str(i) for i in range(1, 31)]
    assert reader.partitions(end, end) == []
    later = ChangeReader({"api": API, **options, "since": "2024-01-02T12:00:00"}, RAW)
    assert [len(list(later.read(p))) for p in later.partitions(later.initialOffset(), end)] == [2]


class Flaky(TableApi):
    calls = 0

    def page(self, *args):
        Flaky.calls += 1
        if Flaky.calls % 2:
            raise paged.FetchError("busy", 429)
        return super().page(*args)


def test_requests_of_a_stream_are_repeated(source, monkeypatch):
    monkeypatch.setattr(paged, "PAUSE", 0)
    options, let = source
    let(7)
    reader = ChangeReader({"api": f"{__name__}:Flaky", **options}, RAW)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert sum(len(list(reader.read(p))) for p in parts) == 7
    assert changes.as_cursor(changes.as_offset(("a", "b"))) == ("a", "b")


def test_ordered_source_holds_one_file(spark, source, tmp_path):
    """Files of 4 rows, by URI, answer as the whole table does; no more than a file is held."""
    options, let = source
    lay_out(spark.read.parquet(options["table"]), f"file://{tmp_path}/ordered", 4)
    laid = options | {"table": f"file://{tmp_path}/ordered", "limit": f"file://{options['limit']}"}
    for limit in (0, 2, 11, 30):
        let(limit)
        whole, ordered = TableApi(options), OrderedApi(laid)
        assert ordered.head() == whole.head() and len(ordered.files) > 7
        for after in (changes.START, ("2024-01-01T12:00:00", ""), ("2024-01-02T00:00:00", "10")):
            for upto in ((whole.head(), ("2024-01-02T00:00:00", "9")) if limit else ()):
                assert ordered.count(after, upto) == whole.count(after, upto)
                assert ordered.page(after, upto, 7) == whole.page(after, upto, 7)
                assert len(ordered.keys) <= 4
                if whole.count(after, upto) > 2:
                    assert ordered.seek(after, 2) == whole.seek(after, 2)


SEEN = "external_record_id string, fingerprint string, run_at timestamp"


def test_keyed_stream_equals_merges(spark, tmp_path):
    """Runs one after another, each taken by a restarted stream, against merges of snapshots."""
    runs = [
        {"a": "1", "b": "1", "c": "1"},
        {"a": "2", "b": "1", "d": "1"},
        {"a": "2", "d": "1"},
        {"a": "2", "c": "1"},
        {"e": "1", "c": "3"},
    ]
    store = SnapshotStore(spark, str(tmp_path / "store"))
    state = incremental.empty(spark, SOURCE_RECORD)
    show = lambda df: sorted(map(repr, df.select(*SOURCE_RECORD.names).collect()))
    for n, found in enumerate(runs):
        at = DAY + dt.timedelta(days=n)
        rows = spark.createDataFrame([(k, f, at) for k, f in found.items()], SEEN)
        rows.write.mode("append").parquet(str(tmp_path / "runs"))
        stream = spark.readStream.schema(SEEN).parquet(str(tmp_path / "runs"))
        keyed.follow(stream, store, "demo", str(tmp_path / "cp"), dt.timedelta(days=1))
        state = rec.merge_state(state, rows, "demo", at, True)
        state = spark.createDataFrame(state.collect(), SOURCE_RECORD)
        assert show(store.read("source_records")) == show(state)


def test_runs_caught_up_in_one_batch(spark, tmp_path):
    """Several runs at once leave the state that they leave one by one; grace waits for the next run."""
    seen = [("a", "1", 0), ("a", "1", 3), ("b", "1", 0), ("b", "1", 1), ("b", "2", 2), ("b", "2", 3), ("c", "1", 2)]
    rows = spark.createDataFrame([(k, f, DAY + dt.timedelta(days=n)) for k, f, n in seen], SEEN)
    rows.write.parquet(str(tmp_path / "runs"))
    store = SnapshotStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(SEEN).parquet(str(tmp_path / "runs"))
    keyed.follow(stream, store, "demo", str(tmp_path / "cp"), dt.timedelta(days=1), grace=dt.timedelta(hours=6))
    found = {r["external_record_id"]: r for r in store.read("source_records").collect()}
    assert found["a"]["source_active"] and found["a"]["source_removed_at"] == DAY + dt.timedelta(days=2)
    assert found["b"]["current_fingerprint"] == "2" and found["b"]["source_removed_at"] is None
    assert found["c"]["consecutive_missing_runs"] == 0  # the run of day 3 may still bring it


@pytest.mark.parametrize("buckets", [1, 3])
def test_records_of_one_bucket_live_apart(spark, tmp_path, buckets):
    """Records that share a bucket miss, return and change each by itself; a bucket is called, not a record."""
    runs = [{f"{i}": "1" for i in range(40)}, {f"{i}": str(i % 3) for i in range(0, 40, 2)}, {f"{i}": "1" for i in range(0, 60, 3)}]
    store = SnapshotStore(spark, str(tmp_path / "store"))
    state = incremental.empty(spark, SOURCE_RECORD)
    for n, found in enumerate(runs):
        at = DAY + dt.timedelta(days=n)
        rows = spark.createDataFrame([(k, f, at) for k, f in found.items()], SEEN)
        rows.write.mode("append").parquet(str(tmp_path / "runs"))
        state = spark.createDataFrame(rec.merge_state(state, rows, "demo", at, True).collect(), SOURCE_RECORD)
    for _ in range(2):  # all runs in one batch, then the timers that are left
        stream = spark.readStream.schema(SEEN).parquet(str(tmp_path / "runs"))
        keyed.follow(stream, store, "demo", str(tmp_path / "cp"), dt.timedelta(days=1), buckets=buckets)
    show = lambda df: sorted(map(repr, df.select(*SOURCE_RECORD.names).collect()))
    assert show(store.read("source_records")) == show(state)
