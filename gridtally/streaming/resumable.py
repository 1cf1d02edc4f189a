"""A complete run in parts, each committed, that goes on where it stopped.

The records are divided into ranges of their numeric ids, planned once.  Each range is
reconciled and committed with three things beside its rows: the ids it saw, appended to
a table of this run, and the held records of the range it did not see; the counters so
far; and the number of the range.  When all ranges are in, what was absent from them is
absent, or, where another run changed records meanwhile, what one anti join of the held
records with the ids seen leaves; the run is judged by its totals, and its row is closed.  A run that stops, however, is taken up
by the next call for its source: it keeps its run_id, its ranges and its time of
observation, and repeats nothing that was committed.  Counters and tables are those of a
run that never stopped.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.operators import reconcile
from gridtally.sources.journal import Journal
from gridtally.sources.schema import FETCHED
from gridtally.sources.state import Change, SnapshotStore
from gridtally.streaming.incremental import batch_change, empty, held_tables, prepared, with_row

#: Records of a part, about.
PART_RECORDS = 1_000_000
COUNTED = ("received", "created", "changed", "unchanged")


def number(record: str = "id"):
    return F.col(record).cast("string").try_cast("bigint")


def plan_ranges(raw: DataFrame, part_records: int = PART_RECORDS) -> list[int]:
    """Upper bounds of all ranges but the last, at quantiles of the numeric ids."""
    count, low, high = raw.agg(F.count("*"), F.min(number()), F.max(number())).first()
    parts = -(-count // part_records)
    if parts < 2 or low is None:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = raw.agg(F.percentile_approx(number(), shares, 10_000).alias("at")).first()["at"]
    return sorted({x for x in found if low <= x < high})


def in_range(raw: DataFrame, bounds: list[int], part: int) -> DataFrame:
    """The records of a range; the last one has the ids that are no numbers, and records without."""
    return raw.where(range_of(bounds, part, "id"))


def range_of(bounds: list[int], part: int, record: str) -> Column:
    """Whether the id in a column lies in a range."""
    at = number(record)
    if not bounds:
        return F.lit(True)
    if part == len(bounds):
        return (at > bounds[-1]) | at.isNull()
    above = at > bounds[part - 1] if part else F.lit(True)
    return above & (at <= bounds[part])


def complete_in_parts(
    store: SnapshotStore,
    raw: DataFrame,
    config: reconcile.SourceConfig,
    run_id: str,
    observed_at: dt.datetime,
    reported: int | None = None,
    part_records: int = PART_RECORDS,
    incident_policy: str = "first_wins",
    journal: Journal | None = None,
    after_part: Callable[[int], None] = lambda part: None,
) -> dict:
    """Run, or go on with, a complete run of a source; its counters and verdict.

    after_part is called with the number of each range once it is committed.  An error
    leaves the run open, to be taken up.
    """
    source = config.source_id
    progress, seen, absent = f"progress:{source}", f"seen-{source}", f"absent-{source}"
    journal = journal or Journal(store, source)
    pointer = store.pointer()
    held, parts = pointer["config"].get(progress), pointer["tables"].get("source_records", [])
    at = held or {
        "run_id": run_id,
        "observed_at": observed_at.isoformat(),
        "bounds": plan_ranges(raw, part_records),
        "done": 0,
        "counts": dict.fromkeys(COUNTED, 0),
        "nameless": 0,
        "held": [len(parts), *parts[:1]],
    }
    run_id, observed_at = at["run_id"], dt.datetime.fromisoformat(at["observed_at"])
    journal.start(run_id)
    base = store.pointer()["config"].get(f"baseline:{source}", config.baseline)
    config = reconcile.replace(config, baseline=base)
    for part in range(at["done"], len(at["bounds"]) + 1):
        with store.staging() as stage:
            records = prepared(stage, in_range(raw, at["bounds"], part))
            after: dict = {}

            def make(pointer: dict, part=part, stage=stage, records=records, after=after) -> Change:
                change, run, outcome = batch_change(
                    store, pointer, stage, records, config, run_id, observed_at, False, None, incident_policy,
                    within=partial(range_of, at["bounds"], part),
                )
                counts = {c: at["counts"][c] + run[f"records_{c}"] for c in COUNTED}
                after.update(at, done=part + 1, counts=counts, nameless=at["nameless"] + records[2])
                change.appended[seen] = outcome.found.select("external_record_id")
                change.appended[absent] = outcome.absent
                change.config = {progress: dict(after)} | journal.alive(pointer, run_id)
                return change

            store.transact(make)
        at = after
        after_part(part)
    return _finish(store, config, journal, at, observed_at, reported)


def _finish(store, config, journal, at: dict, observed_at: dt.datetime, reported: int | None) -> dict:
    """Judge the run by its totals, count absence, close the row."""
    source, run_id = config.source_id, at["run_id"]
    seen_name, absent_name = f"seen-{source}", f"absent-{source}"
    received = at["counts"]["received"]
    verdict = reconcile.judge_run(config, received, reported)
    run = {f"records_{c}": n for c, n in at["counts"].items()} | {
        "run_id": run_id,
        "source_id": source,
        "is_complete": True,
        "status": "completed",
        "plausibility_status": verdict.status,
        "blocking_reason": verdict.reason,
        "deletion_evidence_allowed": verdict.evidence,
        "baseline_count_at_run": verdict.baseline,
        "percent_change_from_baseline": verdict.change_percent,
    }
    if at["nameless"]:
        run["error_message"] = f"{at['nameless']} records without id left out"

    def make(pointer: dict) -> Change:
        change = Change(dropped=[seen_name, absent_name], reads=["source_records"])
        run["records_missing"] = 0
        if verdict.evidence:
            count, *whole = at.get("held", [-1])
            parts = pointer["tables"].get("source_records", [])
            if len(parts) == count + at["done"] and parts[: len(whole)] == whole:
                absent = store.read(absent_name, pointer)
            else:  # another run changed records meanwhile
                state = held_tables(store, pointer)["source_records"]
                seen = store.read(seen_name, pointer)
                absent = reconcile.missing(state.where(F.col("source_id") == F.lit(source)), seen)
            none = empty(store.spark, FETCHED)
            gone = reconcile.merge_state(absent, none, source, observed_at, True, config.missing_limit)
            run["records_missing"] = absent.count()
            change.merged["source_records"] = (gone, ["source_id", "external_record_id"])
        base = received if verdict.status == "plausible" else config.baseline
        change.config = {f"progress:{source}": None, f"baseline:{source}": base}
        return with_row(change, journal.closing(pointer, run))

    store.transact(make)
    return run
