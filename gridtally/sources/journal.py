"""The journal of runs: a row when a run starts, closed with what came of it.

A run announces itself before it reads anything and closes its row in the very commit
that publishes its tables, so data and verdict appear together.  One run of a source is
under way at a time.  A run that was killed never closes its row: the next start finds
it without a sign of life for longer than STALE and fails it.  A run that was failed in
this way and still lives can no longer publish.  Times are the clock's.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.sources.schema import RUN
from gridtally.sources.state import Change, SnapshotStore

STALE = dt.timedelta(hours=1)
KEY = ["run_id"]


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def run_row(spark: SparkSession, run: dict, started: dt.datetime, ended: dt.datetime | None) -> DataFrame:
    row = {f.name: run.get(f.name) for f in RUN} | {"started_at": started, "completed_at": ended}
    return spark.createDataFrame([tuple(row[f.name] for f in RUN)], RUN)


def latest_run(runs: DataFrame, source_id: str) -> DataFrame:
    """The last completed run of a source; of several at that time, the last begun, then by run_id."""
    own = runs.where((runs.source_id == source_id) & (runs.status == "completed"))
    return own.orderBy(*(F.desc(c) for c in ("completed_at", "started_at", "run_id"))).limit(1)


class Journal:
    def __init__(
        self,
        store: SnapshotStore,
        source_id: str,
        clock: Callable[[], dt.datetime] = utc_now,
        stale: dt.timedelta = STALE,
    ):
        self.store, self.source_id, self.clock, self.stale = store, source_id, clock, stale
        self.key = f"running:{source_id}"

    def _row(self, run: dict, started: dt.datetime, ended: dt.datetime | None) -> Change:
        rows = run_row(self.store.spark, run | {"source_id": self.source_id}, started, ended)
        return Change(merged={"runs": (rows, KEY)}, rows={"runs": [run["run_id"]]})

    def start(self, run_id: str) -> dt.datetime:
        """Announce a run; the time it began.  The same run may go on after a break."""
        now = self.clock()

        def make(pointer: dict) -> Change:
            open_run = pointer["config"].get(self.key)
            began = now
            change = Change(config={})
            if open_run and open_run["run_id"] == run_id:
                began = dt.datetime.fromisoformat(open_run["started_at"])
            elif open_run:
                beat = dt.datetime.fromisoformat(open_run["beat_at"])
                if now - beat < self.stale:
                    raise RuntimeError(f"run {open_run['run_id']} of {self.source_id} is under way")
                lost = {"run_id": open_run["run_id"], "status": "failed", "is_complete": False}
                lost |= {"error_message": f"no sign of life since {beat}"}
                change = self._row(lost, dt.datetime.fromisoformat(open_run["started_at"]), now)
            own = self._row({"run_id": run_id, "status": "running"}, began, None)
            if change.merged:
                both = change.merged["runs"][0].unionByName(own.merged["runs"][0])
                change.merged["runs"], change.rows["runs"] = (both, KEY), [*change.rows["runs"], run_id]
            else:
                change = own
            self.began = began
            change.config = {self.key: self._sign(run_id, began, now)}
            return change

        self.store.transact(make)
        return self.began

    @staticmethod
    def _sign(run_id: str, began: dt.datetime, now: dt.datetime) -> dict:
        return {"run_id": run_id, "started_at": began.isoformat(), "beat_at": now.isoformat()}

    def _own(self, pointer: dict, run_id: str) -> dt.datetime:
        open_run = pointer["config"].get(self.key)
        if not open_run or open_run["run_id"] != run_id:
            raise RuntimeError(f"run {run_id} was given up: its row is closed")
        return dt.datetime.fromisoformat(open_run["started_at"])

    def alive(self, pointer: dict, run_id: str) -> dict:
        """The config entry of a sign of life, for a commit in the course of a run."""
        return {self.key: self._sign(run_id, self._own(pointer, run_id), self.clock())}

    def closing(self, pointer: dict, run: dict) -> Change:
        """The row and config that close a run, to be committed with its tables."""
        change = self._row(run, self._own(pointer, run["run_id"]), self.clock())
        change.config = {self.key: None}
        return change

    def fail(self, run_id: str, error: Exception) -> None:
        """Close a run as failed, unless it was closed meanwhile."""
        run = {"run_id": run_id, "status": "failed", "error_message": str(error)[:500], "is_complete": False}

        def make(pointer: dict) -> Change | None:
            open_run = pointer["config"].get(self.key)
            mine = open_run and open_run["run_id"] == run_id
            return self.closing(pointer, run) if mine else None

        self.store.transact(make)
