"""Snapshot reconciliation: what changed, what is missing, and what may be believed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING_LIMIT = 2


def dedupe_last(fetched: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key in the given order, where nulls are least.

    An aggregate and not a window: each task keeps one row of a key before the
    shuffle, so a key with very many rows is no large group.
    """
    rest = [c for c in fetched.columns if c != key]
    last = fetched.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    # The key is the one grouped by, so that a join by it need not move the rows again.
    return last.select(*(c if c == key else F.col(f"_last.{c}").alias(c) for c in fetched.columns))


def outcomes(fetched: DataFrame, state: DataFrame) -> DataFrame:
    """fetched (external_record_id, fingerprint, ...) with kind and reappeared.

    kind is created, changed or unchanged; a record that had been removed and is
    back reappeared, whatever its kind.
    """
    known = state.select(
        "external_record_id",
        F.col("current_fingerprint").alias("_was"),
        F.col("source_active").alias("_active"),
    )
    kind = (
        F.when(F.col("_active").isNull(), "created")
        .when(~F.col("fingerprint").eqNullSafe(F.col("_was")), "changed")
        .otherwise("unchanged")
    )
    joined = fetched.join(known, "external_record_id", "left")
    return joined.withColumns(
        {"kind": kind, "reappeared": F.coalesce(~F.col("_active"), F.lit(False))}
    ).drop("_was", "_active")


def met(fetched: DataFrame, state: DataFrame, absent: bool) -> DataFrame:
    """outcomes with _held, the record's state before; with absent also, without a kind, the
    held records that were not fetched.

    All that a run makes of its records, it makes from these rows alone.
    """
    rest = [c for c in state.columns if c != "external_record_id"]
    held = state.select("external_record_id", F.struct(*rest).alias("_held"))
    fetched = fetched.withColumn("_seen", F.lit(True))
    joined = fetched.join(held, "external_record_id", "full" if absent else "left")
    same = F.col("fingerprint").eqNullSafe(F.col("_held.current_fingerprint"))
    kind = (
        F.when(F.col("_seen").isNull(), F.lit(None))
        .when(F.col("_held.source_active").isNull(), "created")
        .when(~same, "changed")
        .otherwise("unchanged")
    )
    back = F.coalesce(~F.col("_held.source_active"), F.lit(False))
    return joined.withColumns({"kind": kind, "reappeared": F.col("_seen").isNotNull() & back}).drop("_seen")


def counters(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("records_received"),
        F.count_if(F.col("kind") == "created").alias("records_created"),
        F.count_if(F.col("kind") == "changed").alias("records_changed"),
        F.count_if(F.col("kind") == "unchanged").alias("records_unchanged"),
    )


def missing(state: DataFrame, fetched: DataFrame) -> DataFrame:
    """Active records that a fetch did not bring."""
    return state.where("source_active").join(
        fetched.select("external_record_id"), "external_record_id", "left_anti"
    )


def confidence(runs: Column, limit: int = MISSING_LIMIT) -> Column:
    """How sure a removal is after so many runs in a row without the record."""
    return (
        F.when(runs >= limit, "confirmed")
        .when(runs >= 2, "likely")
        .when(runs >= 1, "pending")
        .otherwise("none")
    )


def merge_state(
    state: DataFrame,
    fetched: DataFrame,
    source_id: str,
    observed_at: dt.datetime,
    evidence: bool,
    limit: int = MISSING_LIMIT,
) -> DataFrame:
    """The state after a run, in one full outer join.

    A sighting resets a record; source_removed_at stays as history.  Absence
    counts only with evidence: a complete and plausible run.
    """
    rest = [c for c in state.columns if c != "external_record_id"]
    joined = state.select("external_record_id", F.struct(*rest).alias("_held")).join(
        fetched.select("external_record_id", "fingerprint", F.lit("seen").alias("kind")),
        "external_record_id",
        "full",
    )
    return state_after(joined, source_id, observed_at, evidence, limit)


def state_after(
    rows: DataFrame,
    source_id: str,
    observed_at: dt.datetime,
    evidence: bool,
    limit: int = MISSING_LIMIT,
) -> DataFrame:
    """merge_state of rows that have met: _held is the state before, kind null where absent."""
    now = F.lit(observed_at).cast("timestamp")
    seen = F.col("kind").isNotNull()
    known = F.col("_held").isNotNull()
    absent = ~seen & F.col("_held.source_active") & F.lit(evidence)
    runs = (
        F.when(seen, F.lit(0))
        .when(absent, F.col("_held.consecutive_missing_runs") + 1)
        .otherwise(F.col("_held.consecutive_missing_runs"))
        .cast("int")
    )
    gone = absent & (runs >= limit)
    return (
        rows.select(
            F.when(known, F.col("_held.source_id")).otherwise(F.lit(source_id)).alias("source_id"),
            "external_record_id",
            F.when(seen, True).when(gone, False).otherwise(F.col("_held.source_active"))
            .alias("source_active"),
            F.when(known, F.col("_held.first_seen_at")).otherwise(now).alias("first_seen_at"),
            F.when(seen, now).otherwise(F.col("_held.last_seen_at")).alias("last_seen_at"),
            F.when(gone, now).otherwise(F.col("_held.source_removed_at")).alias("source_removed_at"),
            F.when(seen, "none").when(absent, confidence(runs, limit))
            .otherwise(F.col("_held.removal_confidence")).alias("removal_confidence"),
            runs.alias("consecutive_missing_runs"),
            F.when(seen, F.col("fingerprint")).otherwise(F.col("_held.current_fingerprint"))
            .alias("current_fingerprint"),
        )
    )


def new_versions(
    found: DataFrame, source_id: str, run_id: str, observed_at: dt.datetime, payload: Column
) -> DataFrame:
    """A version of every created or changed record; payload is the whole raw record."""
    return found.where(F.col("kind").isin("created", "changed")).select(
        F.lit(source_id).alias("source_id"),
        "external_record_id",
        F.lit(run_id).alias("run_id"),
        "fingerprint",
        payload.alias("payload"),
        F.lit(observed_at).cast("timestamp").alias("observed_at"),
    )


@dataclass(frozen=True)
class SourceConfig:
    """What is expected of a source's complete runs."""

    source_id: str
    baseline: int | None = None
    manual_hold: bool = False
    protected: bool = True
    floor: int | None = None
    most_drop_percent: float | None = None
    missing_limit: int = MISSING_LIMIT
    watermark: dt.datetime | None = None


@dataclass(frozen=True)
class Verdict:
    status: str
    reason: str | None
    evidence: bool
    baseline: int | None
    change_percent: float | None


def judge_run(
    config: SourceConfig, received: int, reported: int | None = None, schema_valid: bool = True
) -> Verdict:
    """Whether a complete run may count as evidence that records are gone.

    The first objection holds, from the most basic on.  Equal to a bound is
    within it.  A baseline of zero is none.
    """
    base = config.baseline or None
    change = (received - base) / base * 100 if base else None
    guarded = config.protected
    objections = [
        ("schema_validation_failed", not schema_valid),
        ("manual_safety_hold", config.manual_hold),
        ("source_count_mismatch", guarded and reported is not None and reported != received),
        (
            "record_count_below_absolute_floor",
            guarded and config.floor is not None and received < config.floor,
        ),
        (
            "record_count_drop_exceeds_threshold",
            guarded
            and change is not None
            and config.most_drop_percent is not None
            and -change > config.most_drop_percent,
        ),
    ]
    reason = next((name for name, holds in objections if holds), None)
    status = "plausible" if reason is None else "suspicious"
    return Verdict(status, reason, reason is None, config.baseline, change)


def judged(runs: DataFrame) -> DataFrame:
    """judge_run for a table of runs: adds status, reason, evidence and change_percent.

    runs has received, reported, baseline, floor, most_drop_percent, manual_hold,
    protected and schema_valid; null numbers are not asked for.
    """
    received, base = F.col("received"), F.nullif(F.col("baseline"), F.lit(0))
    change = (received - base) / base * 100
    asks = lambda holds: F.col("protected") & F.coalesce(holds, F.lit(False))
    reason = (
        F.when(~F.col("schema_valid"), "schema_validation_failed")
        .when(F.col("manual_hold"), "manual_safety_hold")
        .when(asks(F.col("reported") != received), "source_count_mismatch")
        .when(asks(received < F.col("floor")), "record_count_below_absolute_floor")
        .when(asks(-change > F.col("most_drop_percent")), "record_count_drop_exceeds_threshold")
    )
    return runs.withColumns(
        {
            "change_percent": change,
            "reason": reason,
            "status": F.when(reason.isNull(), "plausible").otherwise("suspicious"),
            "evidence": reason.isNull(),
        }
    )


def promoted(config: SourceConfig, verdict: Verdict, received: int) -> SourceConfig:
    """A plausible complete run sets the next baseline."""
    return replace(config, baseline=received) if verdict.status == "plausible" else config


def promoted_by_hand(config: SourceConfig, run: dict) -> tuple[SourceConfig, str]:
    """Trust a suspicious run after all; its status from then on comes second."""
    if run["source_id"] != config.source_id:
        raise ValueError("the run belongs to another source")
    return replace(config, baseline=run["records_received"]), "overridden_trusted"


def held(config: SourceConfig, on: bool = True) -> SourceConfig:
    """Stop, or allow again, all inference of removals from a source."""
    return replace(config, manual_hold=on)


@dataclass
class Reconciled:
    state: DataFrame
    versions: DataFrame
    found: DataFrame
    run: dict
    absent: DataFrame


def reconcile(
    state: DataFrame,
    fetched: DataFrame,
    config: SourceConfig,
    run_id: str,
    observed_at: dt.datetime,
    payload: Column,
    complete: bool,
    reported: int | None = None,
    schema_valid: bool = True,
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
    absent: bool = False,
) -> Reconciled:
    """One run: two counting jobs settle what absence means; the rest is left to be written.

    Fetched records and state meet in one join; all steps read what that gave, so stage may
    write it once.  Without complete there is no absence to count, and the state holds the
    fetched records only; absent keeps what was not found beside it, for a run in parts.
    """
    rows = stage(met(fetched, state, complete or absent))
    found, lost = rows.where("kind IS NOT NULL"), rows.where("kind IS NULL")
    counts = counters(found).first().asDict()
    if complete:
        verdict = judge_run(config, counts["records_received"], reported, schema_valid)
    else:
        verdict = Verdict("not_evaluated", None, False, config.baseline, None)
    active = lost.where("_held.source_active").select("external_record_id", "_held.*")
    gone = active.count() if verdict.evidence else 0
    return Reconciled(
        state_after(
            rows if complete else found,
            config.source_id, observed_at, verdict.evidence, config.missing_limit,
        ),
        new_versions(found, config.source_id, run_id, observed_at, payload),
        found,
        counts
        | {
            "run_id": run_id,
            "source_id": config.source_id,
            "records_missing": gone,
            "is_complete": complete,
            "status": "completed" if complete else "partial",
            "plausibility_status": verdict.status,
            "blocking_reason": verdict.reason,
            "deletion_evidence_allowed": verdict.evidence,
            "baseline_count_at_run": verdict.baseline,
            "percent_change_from_baseline": verdict.change_percent,
        },
        active,
    )
