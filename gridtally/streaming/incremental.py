"""Incremental ingestion: micro-batches of changed records into the snapshot store.

The file source's checkpoint is the cursor.  A batch that was committed but not
yet acknowledged runs again after a failure; the store remembers the last batch
of each stream, so it is recognised and left out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridtally.operators import grid, reconcile
from gridtally.sources import normalize as nz
from gridtally.sources.journal import Journal
from gridtally.sources.schema import INCIDENT, OFFENSE, SOURCE_RECORD
from gridtally.sources.state import MOST_DELTAS, Change, SnapshotStore

OVERLAP = dt.timedelta(hours=1)


def changed_since(
    records: DataFrame,
    watermark: dt.datetime,
    after_id: str | None = None,
    overlap: dt.timedelta = OVERLAP,
    zone: str | None = None,
) -> DataFrame:
    """Records updated after the watermark less an overlap, in cursor order.

    With zone the watermark (UTC) is turned into that zone's wall clock first,
    which is what a source without time zones writes in updated_on.
    """
    since = F.lit(watermark - overlap).cast("timestamp")
    since = F.from_utc_timestamp(since, zone) if zone else since
    later = F.col("updated_on") > since
    if after_id is not None:
        beyond = nz.id_order(F.col("id")) > nz.id_order(F.lit(after_id))
        later = later | ((F.col("updated_on") == since) & beyond)
    return records.where(later).orderBy("updated_on", nz.id_order(F.col("id")))


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema).where(F.lit(False))  # so that plans leave it out


def prepared(stage, raw: DataFrame) -> tuple[DataFrame, Column, int]:
    """The last of each record with key and fingerprint, its payload, and the number without id.

    The raw records are written once beside the store and read from there.
    """
    raw = stage(raw, "raw")
    keyed = raw.where("id IS NOT NULL")
    last = reconcile.dedupe_last(keyed, "id", F.col("updated_on"), F.unhex(nz.fingerprint(raw)))
    fetched = last.withColumns(
        {
            "external_record_id": F.col("id").cast("string"),
            "fingerprint": nz.fingerprint(last, nz.FINGERPRINTED),
        }
    )
    payload = F.to_json(F.struct(*raw.columns), {"ignoreNullFields": "false"})
    return fetched, payload, raw.where("id IS NULL").count()


def held_tables(
    store: SnapshotStore, pointer: dict, within: Callable[[str], Column] | None = None
) -> dict[str, DataFrame]:
    """The tables of pointer; with within, a condition on a record id, records and offenses so."""
    schemas = {"source_records": SOURCE_RECORD, "incidents": INCIDENT, "offenses": OFFENSE}
    ids = {"source_records": "external_record_id", "offenses": "external_offense_id"} if within else {}
    asked = {name: within(column) for name, column in ids.items()}
    found = {name: store.read(name, pointer, where=asked.get(name)) for name in schemas}
    return {n: empty(store.spark, schemas[n]) if df is None else df for n, df in found.items()}


def batch_change(
    store: SnapshotStore,
    pointer: dict,
    stage,
    records: tuple[DataFrame, Column, int],
    config: reconcile.SourceConfig,
    run_id: str,
    observed_at: dt.datetime,
    complete: bool,
    reported: int | None,
    incident_policy: str,
    within: Callable[[str], Column] | None = None,
) -> tuple[Change, dict, reconcile.Reconciled]:
    """What prepared records change in the tables of pointer, the run's counters, and outcomes.

    within is the condition on ids that holds for all the records, if they are a part; what
    is held is then read so, and the outcomes have what is absent there.  Where a pre-aggregate is held, the rows that bring it up to date belong to the change.
    """
    fetched, payload, nameless = records
    held = held_tables(store, pointer, within)
    state = held["source_records"].where(F.col("source_id") == F.lit(config.source_id))
    incidents, offenses = held["incidents"], held["offenses"]
    done = reconcile.reconcile(
        state, fetched, config, run_id, observed_at, payload, complete, reported,
        stage=lambda found: stage(found, "found"), absent=within is not None,
    )
    run = done.run
    if nameless:
        run["error_message"] = f"{nameless} records without id left out"
    fresh = done.found.where(F.col("kind").isin("created", "changed"))
    new_incidents, _ = nz.normalize(fresh, config.source_id)
    new_offenses = nz.offenses_of(fresh, config.source_id, offenses)
    if incident_policy == "first_wins":
        new_incidents = new_incidents.join(incidents.select("id"), "id", "left_anti")
    elif incident_policy != "latest_wins":
        raise ValueError(incident_policy)
    rollup = "rollup" in pointer["tables"]
    if rollup:
        held = held_tables(store, pointer)
        incidents, offenses = held["incidents"], held["offenses"]
    # What is read once is written where it stays.
    if rollup or len(pointer["tables"].get("incidents", [])) >= MOST_DELTAS:
        new_incidents = stage(new_incidents, "incidents")
    if rollup or len(pointer["tables"].get("offenses", [])) >= MOST_DELTAS:
        new_offenses = stage(new_offenses, "offenses")
    change = Change(
        appended={"versions": done.versions},
        merged={
            "source_records": (done.state, ["source_id", "external_record_id"]),
            "incidents": (new_incidents, ["id"]),
            "offenses": (new_offenses, ["id"]),
        },
    )
    if rollup:
        change.appended["rollup"] = rollup_change(incidents, offenses, new_incidents, new_offenses)
        change.reads = ["rollup"]
    return change, run, done


def rollup_change(
    incidents: DataFrame, offenses: DataFrame, new_incidents: DataFrame, new_offenses: DataFrame
) -> DataFrame:
    """The rows that bring a pre-aggregate of incidents and offenses up to what is new.

    Only incidents that are new, or have new offenses, are counted, before and after.
    """
    told = new_offenses.select(F.col("incident_id").alias("id")).unionByName(new_incidents.select("id"))
    told = told.distinct()
    own = told.select(F.col("id").alias("incident_id"))
    before = (
        incidents.join(told, "id", "left_semi"), offenses.join(own, "incident_id", "left_semi")
    )
    after = tuple(
        old.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new)
        for old, new in zip(before, (new_incidents, new_offenses), strict=True)
    )
    return grid.rollup_delta(before, after)


def ingest_batch(
    store: SnapshotStore,
    raw: DataFrame,
    config: reconcile.SourceConfig,
    run_id: str,
    observed_at: dt.datetime,
    complete: bool = False,
    reported: int | None = None,
    stream: tuple[str, int] | None = None,
    incident_policy: str = "first_wins",
    journal: Journal | None = None,
) -> dict:
    """Reconcile raw records, normalise what is new, and commit all tables at once.

    The raw records are written once beside the store and so are their outcomes, which
    all tables are made from.  Records without an id have no key: they are left out, and
    the run's message says how many.  The run is in the journal from its start; where
    another writer was faster the tables are made again from what it left.  A failure
    closes the run as failed beside the old tables and is raised again.
    """
    source = config.source_id
    batch = f"batch:{stream[0]}" if stream else None
    repeated = lambda pointer: stream and pointer["config"].get(batch, -1) >= stream[1]
    if repeated(store.pointer()):
        return {"run_id": run_id, "status": "repeated"}
    journal = journal or Journal(store, source)
    journal.start(run_id)
    run: dict = {}
    try:
        with store.staging() as stage:
            records = prepared(stage, raw)

            def make(pointer: dict) -> Change:
                base = pointer["config"].get(f"baseline:{source}", config.baseline)
                own = reconcile.replace(config, baseline=base)
                change, made, _ = batch_change(
                    store, pointer, stage, records, own, run_id, observed_at, complete, reported, incident_policy
                )
                run.clear()
                run.update(made)
                if run["plausibility_status"] == "plausible":
                    base = run["records_received"]
                change.config = {f"baseline:{source}": base}
                if stream:
                    change.config[batch] = stream[1]
                return with_row(change, journal.closing(pointer, run))

            store.transact(make)
        return run
    except Exception as error:
        journal.fail(run_id, error)
        raise


def with_row(change: Change, row: Change) -> Change:
    """A change that closes a run as well."""
    change.merged |= row.merged
    change.rows = change.rows | row.rows
    change.config = change.config | row.config
    return change


def ingest_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    store: SnapshotStore,
    config: reconcile.SourceConfig,
    checkpoint: str,
    observed_at: dt.datetime,
    files_per_batch: int = 1,
    kind: str = "json",
) -> None:
    """Take in all files that folder has so far, a few at a time, each batch once."""
    rows = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    run_stream(rows.load(folder), store, config, checkpoint, f"{config.source_id}@{folder}", observed_at)


def run_stream(
    rows: DataFrame,
    store: SnapshotStore,
    config: reconcile.SourceConfig,
    checkpoint: str,
    name: str,
    observed_at: dt.datetime,
    **more,
) -> None:
    """Ingest all that a stream of raw records has so far; each batch once."""

    def batch(df: DataFrame, number: int) -> None:
        run_id = f"{config.source_id}-stream-{number}"
        ingest_batch(store, df, config, run_id, observed_at, stream=(name, number), **more)

    query = (
        rows.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def full_run(store: SnapshotStore, raw: DataFrame, config, run_id, observed_at, **more) -> dict:
    """A complete reconciliation: only here can absence count."""
    return ingest_batch(store, raw, config, run_id, observed_at, complete=True, **more)


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts per window and event type of a stream or a table of events (ts, event_type)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("event_count")
    ).select(F.col("w.start").alias("window_start"), "event_type", "event_count")


