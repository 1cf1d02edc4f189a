"""Incidents laid out so that a place or a page touches few files.

Rows are ordered along a space-filling curve whose first digits are slabs of time, at
quantiles, and whose next ones follow a Hilbert curve over longitude and latitude;
ranges of that order become files.  A small table has the bounds of each file: least and greatest time and
coordinates, and the number of rows.  A request reads it first and then only the files
that can hold an answer.  A box opens one or two tiles of each slab; the latest page
opens one slab.

The bounds belong to one written part of the table.  Increments that came later are
read beside it, as they are; once the table has been merged into a new part, the bounds
no longer apply and all is read until it is clustered again.  Undated and unplaced
rows come first in the order, so they have files of their own.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.operators.filters import Box, Filters, filter_incidents
from gridtally.operators.listing import page
from gridtally.sources.state import Change, SnapshotStore

SLABS, TILES = 32, 64
#: Bits of each coordinate on the curve.
BITS = 12
FILES = "incidents_files"


def curve(lon: Column, lat: Column, box: Box) -> Column:
    """The place of a point on the Hilbert curve through a box; null without coordinates.

    Each of its steps looks at a digit of both coordinates: which quarter they are in, and
    how the curve is turned inside it.
    """
    side = 1 << BITS

    def digits(x: Column, low: float, high: float) -> Column:
        share = (x - F.lit(low)) / F.lit(max(high - low, 1e-9))
        return F.least(F.greatest(F.floor(share * side), F.lit(0)), F.lit(side - 1)).cast("long")

    def step(at: Column, s: Column) -> Column:
        x, y = at["x"], at["y"]
        right, upper = (F.when(v.bitwiseAND(s) > 0, 1).otherwise(0) for v in (x, y))
        far = at["far"] + s * s * (right * 3).bitwiseXOR(upper)
        turned = (right == 1) & (upper == 0)
        x, y = (F.when(turned, F.lit(side - 1) - v).otherwise(v) for v in (x, y))
        swap = upper == 0
        return F.struct(
            F.when(swap, y).otherwise(x).alias("x"), F.when(swap, x).otherwise(y).alias("y"), far.alias("far")
        )

    start = F.struct(
        digits(lon, box.west, box.east).alias("x"),
        digits(lat, box.south, box.north).alias("y"),
        F.lit(0).cast("long").alias("far"),
    )
    steps = F.array(*(F.lit(1 << bit).cast("long") for bit in reversed(range(BITS))))
    placed = lon.isNotNull() & lat.isNotNull()
    return F.when(placed, F.aggregate(steps, start, step)["far"])


def clustered(incidents: DataFrame, slabs: int = SLABS, tiles: int = TILES) -> DataFrame:
    """incidents in slabs * tiles sorted ranges; one pass finds the bounds of slabs and tiles."""
    seconds = F.col("occurred_at").cast("timestamp").cast("double")
    shares = [i / slabs for i in range(1, slabs)]
    west, east, south, north, cuts = incidents.agg(
        F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat"),
        F.percentile_approx(seconds, shares or [0.5], 10_000),
    ).first()
    if west is None or west >= east or south >= north:
        west, east, south, north = -180.0, 180.0, -90.0, 90.0
    z = curve(F.col("lon"), F.col("lat"), Box(west, south, east, north))
    bounds = F.array(*map(F.lit, cuts or [0.0]))
    slab = F.when(seconds.isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b < seconds)))
    placed = incidents.withColumns({"_slab": slab, "_z": z})
    order = ["_slab", "_z", "occurred_at", "id"]
    ranged = placed.repartitionByRange(slabs * tiles, "_slab", "_z", "id").sortWithinPartitions(*order)
    return ranged.drop("_slab", "_z")


def file_bounds(written: DataFrame, part: str) -> DataFrame:
    """part, file, n and the bounds of each file of a written table."""
    time = F.col("occurred_at").cast("timestamp")
    return written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.lit(part).alias("part"),
        F.count("*").alias("n"),
        F.count(time).alias("dated"),
        F.min(time).alias("first_at"),
        F.max(time).alias("last_at"),
        *(f(c).alias(f"{k}_{c}") for c in ("lon", "lat") for k, f in (("min", F.min), ("max", F.max))),
    )


def cluster_incidents(store: SnapshotStore, slabs: int = SLABS, tiles: int = TILES) -> int:
    """Write the incidents of a store in clustered order and the bounds of their files; their number."""

    def make(pointer: dict) -> Change | None:
        held = store.read("incidents", pointer)
        return None if held is None else Change({"incidents": clustered(held, slabs, tiles)})

    store.transact(make)
    parts = store.pointer()["tables"].get("incidents")
    if not parts:
        return 0
    bounds = file_bounds(store.spark.read.parquet(parts[0]), parts[0])
    store.transact(lambda _: Change({FILES: bounds.coalesce(1)}, config={FILES: parts[0]}))
    return store.read(FILES).count()


def bounds_of(store: SnapshotStore, pointer: dict) -> DataFrame | None:
    """The bounds of the files of the incidents, where they are those of the current part."""
    parts = pointer["tables"].get("incidents")
    if not parts or pointer["config"].get(FILES) != parts[0]:
        return None
    return store.read(FILES, pointer).where(F.col("part") == F.lit(parts[0]))


def may_hold(by: Filters) -> Column:
    """Whether a file may hold what a filter asks for; null bounds hold nothing dated or placed."""
    kept = F.lit(True)
    if by.start is not None:
        kept &= F.col("last_at") >= F.lit(by.start).cast("timestamp")
    if by.end is not None:
        kept &= F.col("first_at") < F.lit(by.end + dt.timedelta(days=1)).cast("timestamp")
    if by.box is not None:
        kept &= (F.col("max_lon") >= by.box.west) & (F.col("min_lon") <= by.box.east)
        low, high = by.box.reach()
        kept &= (F.col("max_lat") >= low) & (F.col("min_lat") <= high)
    return kept


def incidents_for(store: SnapshotStore, pointer: dict, by: Filters) -> DataFrame:
    """The incidents of files that a filter may find something in."""
    files = bounds_of(store, pointer)
    if files is None:
        return store.read("incidents", pointer)
    kept = files.where(may_hold(by)).select("file").collect()
    return store.read("incidents", pointer, [r["file"] for r in kept])


def files_since(files: DataFrame, need: int) -> DataFrame:
    """file, since: the files with rows from a time on, after which there are need dated rows.

    The time is the latest that enough files begin at or after.  Running sums go over a
    row per file.
    """
    latest_first = Window.orderBy(F.desc("first_at"), "file").rowsBetween(Window.unboundedPreceding, 0)
    counted = files.withColumn("after", F.sum("dated").over(latest_first))
    enough = F.max(F.when(F.col("after") >= need, F.col("first_at"))).over(Window.partitionBy())
    return counted.withColumn("since", enough).where("last_at >= since").select("file", "since")


def latest_page(
    store: SnapshotStore, pointer: dict, by: Filters, offenses: DataFrame, limit: int = 100, offset: int = 0
) -> DataFrame:
    """A page of the list, latest first, from the files of the latest time that fill it.

    Files that begin at a time or later are enough to fill the page from that time on, if
    what they hold passes the filter; where too little does, the time goes back, over
    four times as many rows each time, at last to the beginning.
    """
    files = bounds_of(store, pointer)
    need = limit + offset
    while files is not None:
        picked = files_since(files.where(may_hold(by) & (F.col("dated") > 0)), need).collect()
        if not picked:
            break
        rows = store.read("incidents", pointer, [r["file"] for r in picked])
        kind = rows.schema["occurred_at"].dataType
        rows = rows.where(F.col("occurred_at") >= F.lit(picked[0]["since"]).cast(kind))
        found = page(filter_incidents(rows, offenses, by), limit, offset)
        if by == Filters() or found.count() == limit:
            return found
        need *= 4
    return page(filter_incidents(incidents_for(store, pointer, by), offenses, by), limit, offset)
