"""The jobs that keep a store up to date: bootstrap, ingest, reference, pre-aggregate."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.operators.grid import rollup_parts
from gridtally.operators.reconcile import SourceConfig
from gridtally.sources.journal import KEY, run_row, utc_now
from gridtally.sources.normalize import id_order, upsert_reference
from gridtally.sources.paged import reported_total
from gridtally.sources.schema import CITY_CONTRACT, Contract, check_schema
from gridtally.sources.state import Change, SnapshotStore
from gridtally.streaming.incremental import OVERLAP, changed_since, ingest_batch
from gridtally.streaming.resumable import PART_RECORDS, complete_in_parts

TIMES = ("watermark",)


def save_config(store: SnapshotStore, config: SourceConfig) -> None:
    """Create or replace what is expected of a source."""
    plain = dataclasses.asdict(config)
    plain |= {n: plain[n].isoformat() if plain[n] else None for n in TIMES}
    store.transact(lambda _: Change(config={f"source:{config.source_id}": plain}))


def load_config(store: SnapshotStore, source_id: str) -> SourceConfig:
    plain = store.pointer()["config"].get(f"source:{source_id}")
    if plain is None:
        raise ValueError(f"unknown source {source_id}")
    times = {n: dt.datetime.fromisoformat(plain[n]) if plain[n] else None for n in TIMES}
    return SourceConfig(**(plain | times))


def checked_fetch(raw: DataFrame, contract: Contract = CITY_CONTRACT) -> DataFrame:
    """raw, if its schema keeps the contract; else nothing is fetched."""
    report = check_schema(raw.schema, contract)
    if not report.valid:
        raise ValueError(f"schema: missing {report.missing}, retyped {report.retyped}")
    return raw


def sample_run(store, raw: DataFrame, source_id: str, run_id: str, now: dt.datetime, limit: int):
    """The first records by id, as a number; never complete, so never evidence of absence."""
    config = load_config(store, source_id)
    first = checked_fetch(raw).orderBy(id_order(F.col("id"))).limit(limit)
    return ingest_batch(store, first, config, run_id, now)


def complete_run(
    store: SnapshotStore,
    raw: DataFrame,
    source_id: str,
    run_id: str,
    started: dt.datetime,
    reported: int | None = None,
    confirm: bool = False,
    part_records: int = PART_RECORDS,
    total: str | None = None,
) -> dict:
    """All records, committed in parts; a run that stopped is taken up.

    total may name, as "module:function", how the source is asked for its own count.
    Must be confirmed; the watermark moves only if the run is trusted.
    """
    if not confirm:
        raise ValueError("a complete run reads the whole source; confirm it")
    config = load_config(store, source_id)
    reported = reported_total(total) if total else reported
    run = complete_in_parts(
        store, checked_fetch(raw), config, run_id, started, reported, part_records
    )
    if run["deletion_evidence_allowed"]:
        save_config(store, dataclasses.replace(config, watermark=started))
    refresh_rollup(store, strict=False, rebuild=False)
    return run


def incremental_run(
    store: SnapshotStore,
    raw: DataFrame,
    source_id: str,
    run_id: str,
    started: dt.datetime,
    overlap: dt.timedelta = OVERLAP,
    zone: str | None = None,
) -> dict:
    """Records that changed since the watermark, which moves to the start of the run."""
    config = load_config(store, source_id)
    if config.watermark is None:
        raise ValueError("no watermark yet: run a complete one first")
    timed = checked_fetch(raw).withColumn("_text", F.col("updated_on")).withColumn(
        "updated_on", F.try_to_timestamp("updated_on")
    )
    fresh = changed_since(timed, config.watermark, overlap=overlap, zone=zone)
    fresh = fresh.withColumn("updated_on", F.col("_text")).drop("_text")
    run = ingest_batch(store, fresh, config, run_id, started)
    save_config(store, dataclasses.replace(config, watermark=started))
    refresh_rollup(store, strict=False, rebuild=False)
    return run


def refresh_reference(store: SnapshotStore, found: DataFrame, key: str, name: str = "codes") -> int:
    """Put reference rows in or over; the number of rows afterwards."""

    def make(pointer: dict) -> Change:
        known = store.read(name, pointer)
        return Change({name: found if known is None else upsert_reference(known, found, key)})

    store.transact(make)
    return store.read(name).count()


def refresh_rollup(store: SnapshotStore, strict: bool = True, rebuild: bool = True) -> int | None:
    """Build the pre-aggregate from the current tables; the number of its rows as stored.

    Each ingest brings one that is there up to date in its own commit, so without rebuild
    it is left as it is.  The old one stays visible until the new one is
    written.  After an ingest a failure is logged as a failed run and let pass
    (strict=False): the data is in, the map lags.
    """

    def make(pointer: dict) -> Change | None:
        incidents, offenses = (store.read(n, pointer) for n in ("incidents", "offenses"))
        if incidents is None or ("rollup" in pointer["tables"] and not rebuild):
            return None
        # Sorted files let a reader skip the row groups of other grids, categories and months.
        cube = rollup_parts(incidents, offenses).sortWithinPartitions("grid", "category", "month")
        return Change({"rollup": cube}, reads=["incidents", "offenses"])

    started = utc_now()
    try:
        store.transact(make)
        cube = store.read("rollup")
        return None if cube is None else cube.count()
    except Exception as error:
        if strict:
            raise
        run = {"run_id": f"rollup-{started.isoformat()}", "status": "failed", "error_message": str(error)[:500]}
        row = run_row(store.spark, run, started, utc_now())
        store.commit(merged={"runs": (row, KEY)}, rows={"runs": [run["run_id"]]})
        return None
