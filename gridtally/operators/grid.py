"""Spatial grid aggregation: from incidents, and from a monthly pre-aggregate."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.operators.filters import Box, Filters, filter_incidents

CELL_LIMIT = 5000
CATEGORY_LIMIT = 20
ROLLUP_GRIDS = (0.05, 0.02)
BREAKDOWN_GRID = 0.05
SNAP = 0.1
ROLLUP_KEY = ["source_id", "grid", "cell_lon", "cell_lat", "month", "category"]
MEASURES = ["n", "sum_lon", "sum_lat"]
#: Of a coordinate, to a tenth of a millimetre, and of sums of them.
PLACE, SUM = "decimal(12,9)", "decimal(38,9)"


def grid_for_zoom(zoom: float) -> float:
    """Degrees per cell at a map zoom level from 0 to 22."""
    if not 0 <= zoom <= 22:
        raise ValueError("zoom must be from 0 to 22")
    steps = ((10, 0.05), (12, 0.02), (14, 0.005))
    return next((size for most, size in steps if zoom <= most), 0.001)


def snapped(box: Box | None) -> Box | None:
    """The box widened to a coarse lattice, so that panned viewports share cache entries.

    The far edge always moves a step on, also from a place on the lattice.
    """
    if box is None:
        return None
    low = [x // SNAP * SNAP for x in (box.west, box.south)]
    high = [(x // SNAP + 1) * SNAP for x in (box.east, box.north)]
    return Box(max(low[0], -180), max(low[1], -90), min(high[0], 180), min(high[1], 90))


def whole_months(start: dt.date | None, end: dt.date | None) -> bool:
    """Whether a range, open ends allowed, consists of calendar months."""
    starts = start is None or start.day == 1
    return starts and (end is None or end.day == calendar.monthrange(end.year, end.month)[1])


def steady(mean: Column) -> Column:
    """Six digits of a mean.

    Coordinates of few digits often average to an exact half of the last digit,
    where the order of summation would decide; a nudge decides instead.
    """
    return F.round(mean + F.lit(1e-9), 6)


def grid_aggregate(incidents: DataFrame, grid: float, limit: int | None = CELL_LIMIT) -> DataFrame:
    """Count located incidents per grid cell; the cell is shown at its points' mean.

    Partial aggregation happens before the shuffle, so a crowded cell costs one
    row per task.  Ties in the count are broken by cell, which makes the top-k
    reproducible.
    """
    cells = (
        incidents.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
        .groupBy(
            F.floor(F.col("lon") / F.lit(grid)).cast("long").alias("cell_x"),
            F.floor(F.col("lat") / F.lit(grid)).cast("long").alias("cell_y"),
        )
        .agg(
            F.count("*").alias("incident_count"),
            steady(F.avg("lon")).alias("lon"),
            steady(F.avg("lat")).alias("lat"),
        )
    )
    if limit is None:
        return cells
    return cells.orderBy(F.desc("incident_count"), "cell_x", "cell_y").limit(limit)


def cell_centre(degrees: Column, grid: Column) -> Column:
    return F.floor(degrees / grid) * grid + grid / 2


def rollup_cells(incidents: DataFrame, offenses: DataFrame, grids=ROLLUP_GRIDS) -> DataFrame:
    """The parts that add up to a pre-aggregate: a row per incident, grid and category.

    Rows of null category count incidents, in all grids; the others count
    incident-offense pairs of a known category.  Only located, dated incidents enter.
    Places are decimals, so that sums are exact and can be taken back.  The incidents
    are read and joined once: an incident is expanded to its categories, null first,
    with the number of its offenses of each.
    """
    pairs = (
        offenses.where(F.col("source_category").isNotNull())
        .groupBy(F.col("incident_id").alias("id"), F.col("source_category").alias("category"))
        .agg(F.count("*").alias("n"))
    )
    known = pairs.groupBy("id").agg(F.collect_list(F.struct("category", "n")).alias("_kinds"))
    placed = incidents.where("lon IS NOT NULL AND lat IS NOT NULL AND occurred_at IS NOT NULL").select(
        "id", "source_id", "lon", "lat", F.date_trunc("month", "occurred_at").cast("date").alias("month")
    )
    kinds = "array<struct<category:string,n:bigint>>"
    whole = F.array(F.struct(F.lit(None).alias("category"), F.lit(1).alias("n"))).cast(kinds)
    every = F.concat(whole, F.coalesce("_kinds", F.array().cast(kinds)))
    spread = placed.join(known, "id", "left").withColumn("kind", F.explode(every))
    spread = spread.withColumn("grid", F.explode(F.array(*map(F.lit, grids))))
    times = F.col("kind.n").cast("decimal(19,0)")
    return spread.select(
        "source_id",
        "grid",
        *(cell_centre(F.col(c), F.col("grid")).alias(f"cell_{c}") for c in ("lon", "lat")),
        "month",
        "kind.category",
        "kind.n",
        *((F.col(c).cast(PLACE) * times).cast(SUM).alias(f"sum_{c}") for c in ("lon", "lat")),
    )


def added_up(parts: DataFrame) -> DataFrame:
    """Parts with one row per key; what has been taken back whole is gone.

    A place that moves within its cell changes the sums and leaves the count.
    """
    sums = [F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in MEASURES]
    return parts.groupBy(*ROLLUP_KEY).agg(*sums).where(" OR ".join(f"{c} <> 0" for c in MEASURES))


def rollup_parts(incidents: DataFrame, offenses: DataFrame, grids=ROLLUP_GRIDS) -> DataFrame:
    """The pre-aggregate as counts and exact sums."""
    return added_up(rollup_cells(incidents, offenses, grids))


def rollup_delta(
    before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], grids=ROLLUP_GRIDS
) -> DataFrame:
    """What turns the pre-aggregate of before into that of after, each (incidents, offenses).

    Both hold the incidents that changed, whole, with all their offenses, before and
    after: what they counted is taken back and what they count is added.
    """
    gone = rollup_cells(*before, grids)
    gone = gone.withColumns({c: (-F.col(c)).cast(gone.schema[c].dataType) for c in MEASURES})
    return added_up(gone.unionByName(rollup_cells(*after, grids)))


def with_means(parts: DataFrame) -> DataFrame:
    """The pre-aggregate from parts: (source, grid, cell, month, category), n, mean place."""
    whole = added_up(parts)
    means = ((F.col(f"sum_{c}").cast("double") / F.col("n")).alias(f"mean_{c}") for c in ("lon", "lat"))
    return whole.select("source_id", "grid", "cell_lon", "cell_lat", "month", "n", *means, "category")


def build_rollup(incidents: DataFrame, offenses: DataFrame, grids=ROLLUP_GRIDS) -> DataFrame:
    """The pre-aggregate: (source, grid, cell, month[, category]) with count and mean place.

    A breakdown from here leaves out what has no place.
    """
    return with_means(rollup_cells(incidents, offenses, grids))


def _months(rollup: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    if start is not None:
        rollup = rollup.where(F.col("month") >= F.lit(start.replace(day=1)))
    if end is not None:
        rollup = rollup.where(F.col("month") <= F.lit(end.replace(day=1)))
    return rollup


def query_rollup(
    rollup: DataFrame,
    grid: float,
    start: dt.date | None = None,
    end: dt.date | None = None,
    category: str | None = None,
    box: Box | None = None,
    limit: int = CELL_LIMIT,
) -> DataFrame:
    """Cells from the pre-aggregate; means of several months are weighted by their counts.

    A box takes whole cells, by their centre.
    """
    kind = F.col("category").isNull() if category is None else F.col("category") == F.lit(category)
    rows = _months(rollup.where((F.col("grid") == F.lit(grid)) & kind), start, end)
    if box is not None:
        rows = rows.where(box.holds(F.col("cell_lon"), F.col("cell_lat")))
    return (
        rows.groupBy("cell_lon", "cell_lat")
        .agg(
            F.sum("n").alias("incident_count"),
            steady(F.sum(F.col("mean_lon") * F.col("n")) / F.sum("n")).alias("lon"),
            steady(F.sum(F.col("mean_lat") * F.col("n")) / F.sum("n")).alias("lat"),
        )
        .orderBy(F.desc("incident_count"), "cell_lon", "cell_lat")
        .limit(limit)
        .select(
            F.round("cell_lon", 6).alias("cell_lon"),
            F.round("cell_lat", 6).alias("cell_lat"),
            "incident_count",
            "lon",
            "lat",
        )
    )


def rollup_breakdown(
    rollup: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    limit: int = CATEGORY_LIMIT,
) -> DataFrame:
    """Pairs per category from the pre-aggregate's coarse grid."""
    rows = rollup.where(
        (F.col("grid") == F.lit(BREAKDOWN_GRID)) & F.col("category").isNotNull()
    )
    counted = _months(rows, start, end).groupBy("category").agg(F.sum("n").alias("offense_count"))
    return counted.orderBy(F.desc("offense_count"), "category").limit(limit)


def goes_to_rollup(by: Filters, grid: float) -> bool:
    """Whether the pre-aggregate can answer: no area filter, a known grid, whole months."""
    plain = by.neighborhood is None and by.district is None
    return plain and grid in ROLLUP_GRIDS and whole_months(by.start, by.end)


def aggregate(
    incidents: DataFrame, offenses: DataFrame, rollup: DataFrame, zoom: float, by: Filters
) -> DataFrame:
    """Map cells for a viewport: lon, lat, incident_count, grid_degrees, answered_by.

    The box is snapped only where the pre-aggregate answers.
    """
    grid = grid_for_zoom(zoom)
    if goes_to_rollup(by, grid):
        cells = query_rollup(rollup, grid, by.start, by.end, by.category, snapped(by.box))
        path = "rollup"
    else:
        cells, path = grid_aggregate(filter_incidents(incidents, offenses, by), grid), "raw"
    return cells.select(
        "lon", "lat", "incident_count", F.lit(grid).alias("grid_degrees"),
        F.lit(path).alias("answered_by"),
    )


def total(cells: DataFrame) -> DataFrame:
    """incident_count: the sum over cells."""
    return cells.agg(F.coalesce(F.sum("incident_count"), F.lit(0)).alias("incident_count"))
