"""Clustered files and deep pages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridtally.operators import listing
from gridtally.operators.filters import Box, Filters, filter_incidents
from gridtally.sources import clustered
from gridtally.sources.schema import INCIDENT, OFFENSE
from gridtally.sources.state import SnapshotStore

SLABS, TILES = 32, 64
BLOCK = Filters(box=Box(-87.65, 41.85, -87.64, 41.86))


@pytest.fixture(scope="module")
def city(spark):
    """20,000 incidents over a city and twenty years; some undated, some without a place."""
    known = {
        "id": "lpad(cast(i AS string), 6, '0')",
        "source_id": "'demo'",
        "occurred_at": "if(i % 997 = 0, NULL, timestamp'2000-01-01' + make_interval(0, 0, 0, 0, (i * 7919) % 175000))",
        "lon": "if(i % 331 = 0, NULL, -88.0D + ((i * 104729L) % 70000) * 1e-5D)",
        "lat": "if(i % 331 = 0, NULL, 41.6D + ((i * 15485863L) % 45000) * 1e-5D)",
        "neighborhood": "cast(i % 77 AS string)",
    }
    columns = [F.expr(known.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in INCIDENT]
    return spark.range(20_000).selectExpr("id AS i").select(*columns)


@pytest.fixture(scope="module")
def store(spark, city, tmp_path_factory):
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("store")))
    store.commit(merged={"incidents": (city, ["id"])})
    assert clustered.cluster_incidents(store, SLABS, TILES) == SLABS * TILES
    return store


def offenses(spark):
    return spark.createDataFrame([], OFFENSE)


def files_read(df):
    df.collect()
    scans, open_nodes = [], [df._jdf.queryExecution().executedPlan()]
    while open_nodes:
        node = open_nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            open_nodes.append(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            open_nodes.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            scans.append(node.metrics().apply("numFiles").value())
        children = node.children()
        open_nodes += [children.apply(i) for i in range(children.size())]
    return sum(scans)


def shown(df):
    return [tuple(r) for r in df.select("id", "occurred_at").collect()]


def test_a_block_opens_few_files(spark, store, city):
    rows = filter_incidents(clustered.incidents_for(store, store.pointer(), BLOCK), offenses(spark), BLOCK)
    plain = filter_incidents(city, offenses(spark), BLOCK)
    assert sorted(shown(rows)) == sorted(shown(plain)) and rows.count() > 3
    assert files_read(rows) < 0.05 * SLABS * TILES
    week = Filters(start=dt.date(2010, 5, 1), end=dt.date(2010, 5, 7), box=BLOCK.box)
    rows = filter_incidents(clustered.incidents_for(store, store.pointer(), week), offenses(spark), week)
    assert files_read(rows) < 0.05 * SLABS * TILES


@pytest.mark.parametrize("limit, offset", [(100, 0), (500, 700), (50, 19_970), (50, 20_000)])
def test_latest_page(spark, store, city, limit, offset):
    found = clustered.latest_page(store, store.pointer(), Filters(), offenses(spark), limit, offset)
    assert shown(found) == shown(listing.page(city, limit, offset))
    if offset == 0:
        assert files_read(found) < 0.05 * SLABS * TILES


@pytest.mark.parametrize("by", [Filters(neighborhood="5"), BLOCK, Filters(end=dt.date(2004, 3, 1)), Filters(neighborhood="none")])
def test_filtered_page(spark, store, city, by):
    found = clustered.latest_page(store, store.pointer(), by, offenses(spark), 40, 3)
    assert shown(found) == shown(listing.page(filter_incidents(city, offenses(spark), by), 40, 3))


def test_increments_are_read_beside_the_files(spark, city, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.commit(merged={"incidents": (city, ["id"])})
    clustered.cluster_incidents(store, 4, 4)
    moved = city.where("id < '000100'").withColumns({"lon": F.lit(-87.645), "lat": F.lit(41.855), "occurred_at": F.lit("2030-01-01").cast("timestamp")})
    store.commit(merged={"incidents": (moved, ["id"])})
    now = moved.unionByName(city.where("id >= '000100'"))
    rows = filter_incidents(clustered.incidents_for(store, store.pointer(), BLOCK), offenses(spark), BLOCK)
    assert sorted(shown(rows)) == sorted(shown(filter_incidents(now, offenses(spark), BLOCK)))
    found = clustered.latest_page(store, store.pointer(), Filters(), offenses(spark), 30)
    assert shown(found) == shown(listing.page(now, 30))
    store.commit({"incidents": now})
    assert clustered.bounds_of(store, store.pointer()) is None
    assert clustered.latest_page(store, store.pointer(), Filters(), offenses(spark), 30).count() == 30


def test_curve_keeps_neighbours(spark):
    """Each place of a small square once, and each next to the one before."""
    side = 1 << clustered.BITS
    points = spark.sql("SELECT x.id AS x, y.id AS y FROM range(16) AS x, range(16) AS y")
    box = type("Square", (), {"west": 0.0, "south": 0.0, "east": float(side), "north": float(side)})
    at = clustered.curve(F.col("x") + 0.5, F.col("y") + 0.5, box)
    rows = sorted(points.select(at.alias("at"), "x", "y").collect())
    assert [r["at"] for r in rows] == list(range(256))
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in zip(rows, rows[1:], strict=False))
    odd = spark.sql("SELECT 9e9D AS x, -1D AS y UNION ALL SELECT NULL, 1D")
    assert {r[0] is None for r in odd.select(clustered.curve(F.col("x"), F.col("y"), box)).collect()} == {True, False}


@pytest.mark.parametrize("limit, offset", [(100, 0), (100, 10_000), (7, 19_975), (500, 19_970), (10, 30_000)])
def test_deep_page(city, limit, offset):
    found = listing.deep_page(city, limit, offset, most=300)
    assert shown(found) == shown(listing.page(city, limit, offset))


def test_deep_page_sorts_a_part(city):
    plan = listing.deep_page(city, 100, 10_000, most=300)._jdf.queryExecution().executedPlan().toString()
    kept = int(plan.split("TakeOrderedAndProject(limit=")[1].split(",")[0])
    assert kept < 500 and "occurred_at" in plan


def test_pages_one_after_another(city):
    few = city.where("id < '000300' OR occurred_at IS NULL")
    whole, last, got = shown(few.orderBy(F.desc_nulls_last("occurred_at"), "id")), None, []
    while True:
        rows = shown(listing.page(few, 50) if last is None else listing.page_after(few, last, 50))
        got += rows
        if len(rows) < 50:
            break
        last = rows[-1][1], rows[-1][0]
    assert got == whole
