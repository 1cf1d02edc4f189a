"""Answers to a client's requests, as plain values, from one version of a store.

Each request resolves the pointer once.  Answers are kept for a while under the
request and the version, so a new version is never hidden by an old answer.
"""

from __future__ import annotations

import datetime as dt
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridtally.operators import grid, listing, summary
from gridtally.operators.filters import Filters, checked_page, filter_incidents
from gridtally.sources.clustered import latest_page
from gridtally.sources.schema import INCIDENT, OFFENSE, RUN
from gridtally.sources.state import SnapshotStore

KEPT_SECONDS, KEPT_ANSWERS = 120.0, 1000


class Answers:
    """A bounded cache with an age limit; the oldest answer goes first."""

    def __init__(self, seconds: float = KEPT_SECONDS, most: int = KEPT_ANSWERS, clock=time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self.held: OrderedDict = OrderedDict()

    def get(self, key, make: Callable[[], dict]) -> dict:
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.seconds:
            return self.held[key][1]
        answer = make()
        self.held[key] = (now, answer)
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return answer


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Service:
    def __init__(
        self, spark: SparkSession, store: SnapshotStore, names: DataFrame | None = None
    ):
        self.spark, self.store, self.names, self.answers = spark, store, names, Answers()

    def _tables(self, pointer: dict) -> tuple[DataFrame, DataFrame]:
        found = []
        for name, schema in (("incidents", INCIDENT), ("offenses", OFFENSE)):
            df = self.store.read(name, pointer)
            found.append(self.spark.createDataFrame([], schema) if df is None else df)
        incidents, offenses = found
        return incidents, offenses.withColumnRenamed("external_offense_id", "line")

    def _rollup(self, pointer: dict) -> DataFrame | None:
        parts = self.store.read("rollup", pointer)
        return None if parts is None else grid.with_means(parts)

    def incidents(self, by: Filters = Filters(), limit: int = 100, offset: int = 0) -> dict:  # noqa: B008
        """A page with nested offenses, and the total up to the cap."""
        checked_page(limit, offset)
        pointer = self.store.pointer()
        incidents, offenses = self._tables(pointer)
        found = filter_incidents(incidents, offenses, by)
        page = found.limit(0)
        if "incidents" in pointer["tables"]:
            page = latest_page(self.store, pointer, by, offenses, limit, offset)
        shown = listing.page(listing.with_offenses(page, offenses), limit)
        total = listing.capped_count(found).first()[0]
        return {"items": rows(shown), "total": total, "limit": limit, "offset": offset}

    def aggregate(self, zoom: float, by: Filters = Filters()) -> dict:  # noqa: B008
        """Map cells; from the pre-aggregate where it can answer."""
        pointer, size = self.store.pointer(), grid.grid_for_zoom(zoom)

        def make() -> dict:
            tables = self._tables(pointer)
            rollup = self._rollup(pointer)
            if rollup is None:
                cells, path = grid.grid_aggregate(filter_incidents(*tables, by), size), "raw"
            else:
                cells = grid.aggregate(*tables, rollup, zoom, by)
                path = "rollup" if grid.goes_to_rollup(by, size) else "raw"
            shown = rows(cells.select("lon", "lat", "incident_count"))
            return {"cells": shown, "grid_degrees": size, "source": path}

        return self.answers.get((pointer["version"], size, by), make)

    def summary(self, by: Filters, today: dt.date | None = None, strict: bool = False) -> dict:
        pointer = self.store.pointer()
        rollup = self._rollup(pointer)
        made = summary.summarise(*self._tables(pointer), rollup, by, self.names, today, strict)
        categories, areas = rows(made.categories), rows(made.areas)
        return {
            "start": made.period.start,
            "end": made.period.end,
            "clamped": made.period.clamped,
            "current": made.current,
            "previous": made.previous,
            "percent_change": made.change,
            "bucket": made.period.bucket,
            "series": rows(made.buckets),
            "categories": categories,
            "areas": areas,
            "most_common_category": categories[0]["category"] if categories else None,
            "most_common_area": areas[0]["neighborhood"] if areas else None,
            "breakdown_source": made.breakdown_by,
        }

    def status(self) -> list[dict]:
        pointer = self.store.pointer()
        runs = self.store.read("runs", pointer)
        runs = self.spark.createDataFrame([], RUN) if runs is None else runs
        return rows(listing.status(*self._tables(pointer), runs))

    def categories(self) -> list[str]:
        found = listing.categories(self._tables(self.store.pointer())[1])
        return [r["source_category"] for r in found.collect()]

    @staticmethod
    def health() -> dict:
        return {"status": "ok"}
