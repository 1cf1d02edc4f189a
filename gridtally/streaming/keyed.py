"""Reconciliation as a keyed stream: a state per record, timers for runs without it.

The input is a stream of sightings (external_record_id, fingerprint, run_at), one for
each record of each trusted run; runs come every period.  A record's state is kept by
Spark under its bucket, in the state store and the checkpoint.  A sighting resets it and
sets a timer for the next run; the timer goes off when the watermark, the latest run
seen, has passed that run and the record has not come: one run is missing, as in a
reconciliation of snapshots.  Each change of a state is one output row, so a sink that
keeps the last row of a key holds the table that merge_state makes.

Records are kept in buckets by a hash of their id, a bucket's states as one value of
columns (an Arrow stream) with the timer of its record that is due first: a run brings
most records, and to ask the state store for each one alone took milliseconds a record.
The number of buckets is fixed with the checkpoint; it should leave a bucket some ten
thousand records.

A run may come in several micro-batches: grace delays the timers by as much, and a
run is then judged once the next one begins.  Runs that may not count as evidence of
absence do not belong into the stream; a period without a run leaves the watermark, and
so all timers, where they are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridtally.operators.reconcile import MISSING_LIMIT
from gridtally.sources.schema import SOURCE_RECORD
from gridtally.sources.state import Change, SnapshotStore

STATE = (
    "active boolean, first_ms long, last_ms long, removed_ms long, missing int, fingerprint string, due_ms long"
)
KEY = "external_record_id"
OUT = f"{KEY} string, kind string, {STATE}"
OUT_NAMES = [x.split()[0] for x in OUT.split(", ")]
#: Columns of a bucket's state; a record that was never removed has NEVER there.
TEXTS = (KEY, "fingerprint")
KINDS = {"boolean": bool, "int": np.int32, "long": np.int64, "string": object}
HELD = {KEY: object} | {n: KINDS[kind] for n, kind in (x.split() for x in STATE.split(", "))}
NEVER = -(2**62)
#: Buckets of records; a checkpoint belongs to one number.  One bucket is held by a task at a time.
BUCKETS = 4096
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BucketLife(StatefulProcessor):
    """The records of a bucket, each from its first sighting on."""

    def __init__(self, period_ms: int, grace_ms: int, limit: int):
        self.period, self.grace, self.limit = period_ms, grace_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("records", "held binary")

    def close(self) -> None:
        pass

    def _held(self) -> dict[str, np.ndarray]:
        """The bucket's records by column."""
        if not self.state.exists():
            return {n: np.empty(0, kind) for n, kind in HELD.items()}
        table = pa.ipc.open_stream(bytes(self.state.get()[0])).read_all()
        return {n: table[n].to_numpy().astype(kind) for n, kind in HELD.items()}

    def _missed(self, held: dict, at: np.ndarray, until: int) -> None:
        """Count the runs due before until that did not bring the records at these places."""
        while len(at := at[held["active"][at] & (held["due_ms"][at] < until)]):
            held["missing"][at] += 1
            gone = at[held["missing"][at] >= self.limit]
            held["active"][gone], held["removed_ms"][gone] = False, held["due_ms"][gone]
            held["due_ms"][at] += self.period

    def _keep(self, held: dict, at: np.ndarray, kinds: np.ndarray) -> pd.DataFrame:
        """Store the bucket, set its timer; the states of the records at these places."""
        wanted = held["due_ms"][held["active"]]
        wanted = {int(wanted.min()) + self.grace} if len(wanted) else set()
        timers = set(self.handle.listTimers())
        for timer in timers - wanted:
            self.handle.deleteTimer(timer)
        for timer in wanted - timers:
            self.handle.registerTimer(timer)
        text = {n: pa.string() for n in TEXTS}
        table = pa.table({n: pa.array(x, text.get(n)) for n, x in held.items()})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(),))
        shown = pd.DataFrame({n: x[at] for n, x in held.items()})
        removed = shown["removed_ms"].astype("Int64").mask(shown["removed_ms"] == NEVER)
        return shown.assign(removed_ms=removed, kind=kinds)[OUT_NAMES]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        seen = pd.concat(list(rows), ignore_index=True).sort_values("run_ms", kind="stable")
        first = seen.drop_duplicates(KEY)
        fresh = first[~first[KEY].isin(held[KEY])]
        begin, known = fresh["run_ms"].to_numpy(), len(held[KEY])
        new = {
            KEY: fresh[KEY], "active": True, "first_ms": begin, "last_ms": begin, "removed_ms": NEVER,
            "missing": 0, "fingerprint": None, "due_ms": begin,
        }
        new = pd.DataFrame(new, index=fresh.index)
        held = {n: np.concatenate([x, new[n].to_numpy().astype(HELD[n])]) for n, x in held.items()}
        kinds = np.where(np.arange(len(held[KEY])) < known, "unchanged", "created").astype(object)
        seen["at"] = pd.Index(held[KEY]).get_indexer(seen[KEY])
        # A record has one row at most in each step, as runs come one after another.
        for (run, _), step in seen.groupby(["run_ms", seen.groupby(["run_ms", "at"]).cumcount()]):
            at, prints = step["at"].to_numpy(), step["fingerprint"].astype(object)
            prints = prints.where(prints.notna(), None).to_numpy()
            self._missed(held, at, run)
            other = (kinds[at] == "unchanged") & (held["fingerprint"][at] != prints)
            kinds[at[other]] = "changed"
            held["active"][at], held["missing"][at] = True, 0
            held["last_ms"][at], held["due_ms"][at], held["fingerprint"][at] = run, run + self.period, prints
        at = np.unique(seen["at"].to_numpy())
        yield self._keep(held, at, kinds[at])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, until = self._held(), timerValues.getCurrentWatermarkInMs() - self.grace + 1
        late = np.flatnonzero(held["active"] & (held["due_ms"] < until))
        self._missed(held, late, until)
        yield self._keep(held, late, np.full(len(late), "missing", object))


def record_states(
    sightings: DataFrame,
    source_id: str,
    period: dt.timedelta,
    grace: dt.timedelta = dt.timedelta(0),
    limit: int = MISSING_LIMIT,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The stream of states: SOURCE_RECORD columns and kind, a row for each change of a record."""
    ms = [int(x / dt.timedelta(milliseconds=1)) for x in (period, grace)]
    keyed = (
        sightings.withWatermark("run_at", "0 seconds")
        .select(
            F.pmod(F.xxhash64(KEY), F.lit(buckets)).alias("bucket"),
            KEY, "fingerprint", "run_at", F.unix_millis("run_at").alias("run_ms"),
        )
        .groupBy("bucket")
    )
    life = BucketLife(*ms, limit)
    out = keyed.transformWithStateInPandas(life, OUT, "Update", "EventTime")
    confidence = (
        F.when(F.col("missing") >= limit, "confirmed")
        .when(F.col("missing") >= 2, "likely")
        .when(F.col("missing") >= 1, "pending")
        .otherwise("none")
    )
    return out.select(
        F.lit(source_id).alias("source_id"),
        "external_record_id",
        F.col("active").alias("source_active"),
        F.timestamp_millis("first_ms").alias("first_seen_at"),
        F.timestamp_millis("last_ms").alias("last_seen_at"),
        F.timestamp_millis("removed_ms").alias("source_removed_at"),
        confidence.alias("removal_confidence"),
        F.col("missing").alias("consecutive_missing_runs"),
        F.col("fingerprint").alias("current_fingerprint"),
        "kind",
    )


def follow(sightings: DataFrame, store: SnapshotStore, source_id: str, checkpoint: str, period: dt.timedelta, **more):
    """Run all that sightings has so far into the store's source_records; each batch once."""
    spark, key = store.spark, ["source_id", "external_record_id"]
    name = f"batch:states-{source_id}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def put(states: DataFrame, number: int) -> None:
        with store.staging() as stage:
            fresh = stage(states.select(*SOURCE_RECORD.names), "states")

            def make(pointer: dict) -> Change | None:
                if pointer["config"].get(name, -1) >= number:
                    return None
                return Change(merged={"source_records": (fresh, key)}, config={name: number})

            if not fresh.isEmpty():
                store.transact(make)

    states = record_states(sightings, source_id, period, **more)
    query = (
        states.writeStream.foreachBatch(put)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
