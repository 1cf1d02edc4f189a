"""Filters, lists, grids and summaries over a hand-made set of incidents."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridtally.functions import display
from gridtally.operators import grid, listing, summary
from gridtally.operators.filters import Box, Filters, checked_page, checked_range, filter_incidents

# id, day, area, district, lon, lat, categories
ROWS = [
    (1, "2020-01-05", "1", "N", -87.61, 41.81, ["THEFT"]),
    (2, "2020-01-31 23:59:59", "1", "N", -87.62, 41.81, ["THEFT", "THEFT"]),
    (3, "2020-02-01", "1", "S", -87.63, 41.82, ["ASSAULT"]),
    (4, "2020-02-10", "2", "S", -87.71, 41.91, ["ASSAULT", "THEFT"]),
    (5, "2020-02-29 12:00:00", "2", None, None, None, ["ASSAULT", None]),
    (6, None, "2", "N", -87.61, 41.81, []),
    (7, "2019-12-31", None, "N", -87.61, 41.84, ["ARSON"]),
]


@pytest.fixture(scope="module")
def tables(spark):
    shape = "id long, source_id string, occurred_at timestamp, neighborhood string, district string, lon double, lat double"
    rows = [
        (i, "demo", day and dt.datetime.fromisoformat(day), area, d, lon, lat)
        for i, day, area, d, lon, lat, _ in ROWS
    ]
    crimes = [(i, "demo", k, c) for i, *_, kinds in ROWS for k, c in enumerate(kinds)]
    form = "incident_id long, source_id string, line int, source_category string"
    return spark.createDataFrame(rows, shape), spark.createDataFrame(crimes, form)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize(
    "by, expected",
    [
        (Filters(), [1, 2, 3, 4, 5, 6, 7]),
        (Filters(start=dt.date(2020, 1, 31), end=dt.date(2020, 1, 31)), [2]),
        (Filters(end=dt.date(2020, 2, 29)), [1, 2, 3, 4, 5, 7]),
        (Filters(category="THEFT"), [1, 2, 4]),
        (Filters(neighborhood="2", category="ASSAULT"), [4, 5]),
        (Filters(district="N"), [1, 2, 6, 7]),
        (Filters(box=Box(-87.62, 41.8, -87.61, 41.81)), [1, 2, 6]),
        (Filters(source_id="other"), []),
    ],
)
def test_filters(tables, by, expected):
    assert ids(filter_incidents(*tables, by)) == expected


@pytest.mark.parametrize("by", [Filters(category="THEFT"), Filters(neighborhood="1"), Filters()])
def test_every_metric_honours_every_filter(tables, by):
    found = filter_incidents(*tables, by)
    n = found.count()
    assert listing.count(found).first()[0] == n
    assert listing.capped_count(found, 3).first()[0] == min(n, 3)
    dated = found.where("occurred_at IS NOT NULL").count()
    assert summary.series(found, "month").agg(F.sum("incident_count")).first()[0] == dated
    named = found.where("neighborhood IS NOT NULL").count()
    assert summary.top_areas(found).agg(F.sum("incident_count")).first()[0] == named


def test_checks():
    assert Box.of() is None
    for wrong in ((1, None, 2, 3), (2, 0, 1, 1), (-200, 0, 1, 1)):
        with pytest.raises(ValueError):
            Box.of(*wrong)
    for page in ((0, 0), (501, 0), (1, -1)):
        with pytest.raises(ValueError):
            checked_page(*page)
    day = dt.date(2020, 1, 1)
    with pytest.raises(ValueError):
        checked_range(day, day - dt.timedelta(1))
    with pytest.raises(ValueError):
        checked_range(day, day, first=day + dt.timedelta(1))
    with pytest.raises(ValueError):
        grid.grid_for_zoom(23)


def test_pages_do_not_overlap(tables):
    pages = [[r["id"] for r in listing.page(tables[0], 3, o).collect()] for o in (0, 3, 6)]
    assert [len(p) for p in pages] == [3, 3, 1] and len(set(sum(pages, []))) == 7
    assert pages[2] == [6]  # undated last


def test_nested_offenses(tables):
    rows = {r["id"]: r["offenses"] for r in listing.with_offenses(*tables).collect()}
    assert rows[6] == [] and [o["source_category"] for o in rows[4]] == ["ASSAULT", "THEFT"]


def test_zoom_and_snap():
    assert [grid.grid_for_zoom(z) for z in (0, 10, 11, 12, 14, 15)] == [0.05, 0.05, 0.02, 0.02, 0.005, 0.001]
    wide = grid.snapped(Box(-87.65, 41.75, -87.6, 41.8))
    assert wide.west <= -87.65 and wide.east > -87.6 and wide.south <= 41.75 and wide.north >= 41.8


@pytest.mark.parametrize(
    "start, end, whole",
    [
        (None, None, True),
        (dt.date(2020, 2, 1), dt.date(2020, 2, 29), True),
        (dt.date(2021, 2, 1), dt.date(2021, 2, 28), True),
        (dt.date(2020, 2, 1), dt.date(2020, 2, 28), False),
        (dt.date(2020, 2, 2), None, False),
    ],
)
def test_whole_months(start, end, whole):
    assert grid.whole_months(start, end) is whole


@pytest.mark.parametrize("size", grid.ROLLUP_GRIDS)
def test_rollup_equals_raw_for_located_and_dated(tables, size):
    rolled = grid.query_rollup(grid.build_rollup(*tables), size)
    raw = grid.grid_aggregate(tables[0].where("occurred_at IS NOT NULL"), size)
    pick = ["incident_count", "lon", "lat"]
    assert sorted(rolled.select(*pick).collect()) == sorted(raw.select(*pick).collect())


def test_rollup_breakdown_leaves_out_what_has_no_place(tables):
    found, crimes = tables
    rolled = {r[0]: r[1] for r in grid.rollup_breakdown(grid.build_rollup(*tables)).collect()}
    raw = {r[0]: r[1] for r in summary.breakdown(found, crimes).collect()}
    assert rolled == {"THEFT": 4, "ASSAULT": 2, "ARSON": 1}
    assert raw == {"THEFT": 4, "ASSAULT": 3, "ARSON": 1, None: 1}


def test_category_counts_pairs_in_rollup_and_incidents_in_raw(tables):
    rolled = grid.query_rollup(grid.build_rollup(*tables), 0.05, category="THEFT")
    raw = grid.grid_aggregate(filter_incidents(*tables, Filters(category="THEFT")), 0.05)
    assert rolled.agg(F.sum("incident_count")).first()[0] == 4
    assert raw.agg(F.sum("incident_count")).first()[0] == 3


def test_router(tables):
    rollup = grid.build_rollup(*tables)
    month = Filters(start=dt.date(2020, 2, 1), end=dt.date(2020, 2, 29))
    answers = {
        (zoom, by): grid.aggregate(*tables, rollup, zoom, by).first()["answered_by"]
        for zoom, by in [(9, month), (13, month), (9, Filters(neighborhood="1")), (9, Filters(district="N"))]
    }
    assert list(answers.values()) == ["rollup", "raw", "raw", "raw"]


def test_period_defaults_and_clamp():
    latest = dt.date(2020, 3, 31)
    p = summary.resolve_period(None, None, latest)
    assert (p.end - p.start).days == 30 and p.bucket == "week" and not p.clamped
    assert p.before == (dt.date(2020, 1, 30), dt.date(2020, 2, 29))
    late = summary.resolve_period(dt.date(2020, 1, 1), dt.date(2020, 12, 31), latest)
    assert late.end == latest and late.clamped and late.bucket == "month"
    early = summary.resolve_period(None, dt.date(2020, 1, 1), latest)
    assert early.start > early.end
    with pytest.raises(ValueError):
        summary.resolve_period(None, dt.date(2020, 1, 1), latest, strict=True)


def test_percent_change():
    assert summary.percent_change(3, 2) == 50.0 and summary.percent_change(1, 0) is None
    assert summary.percent_change(409, 400) == 2.2  # half to even, as Python rounds


def test_summary(tables):
    names = tables[0].sparkSession.createDataFrame([("1", "One")], "code string, name string")
    by = Filters("demo", dt.date(2020, 2, 1), dt.date(2020, 2, 29))
    made = summary.summarise(*tables, grid.build_rollup(*tables), by, names)
    assert (made.current, made.previous, made.breakdown_by) == (3, 2, "rollup")
    assert made.change == 50.0
    assert {r["neighborhood"]: r["area_name"] for r in made.areas.collect()} == {"1": "One", "2": None}
    raw = summary.summarise(*tables, None, by)
    assert raw.breakdown_by == "raw"


def test_partial_bucket(tables):
    rows = summary.series(tables[0], "month", dt.date(2020, 2, 10)).collect()
    assert [r["is_partial"] for r in rows] == [False, False, True]


def test_status(tables, spark):
    runs = spark.createDataFrame([], "source_id string, status string, completed_at timestamp, is_complete boolean")
    row = listing.status(*tables, runs).first()
    assert row["incident_count"] == 7 and row["offense_count"] == 9 and not row["is_complete"]
    nothing = listing.status(tables[0].limit(0), tables[1].limit(0), runs)
    assert nothing.count() == 0


def test_labels(spark):
    df = spark.sql("SELECT '1' AS code, 'One' AS name, 12.5 AS change UNION ALL SELECT NULL, NULL, NULL UNION ALL SELECT '9', NULL, -3.0")
    shown = df.select(
        display.area_label(F.col("code"), F.col("name")), display.percent_label(F.col("change").cast("double"))
    ).collect()
    assert [tuple(r) for r in shown] == [("One (1)", "+12.5%"), ("—", "—"), ("Unknown (9)", "-3.0%")]
    sizes = spark.createDataFrame([(0,), (1,), (50,), (275,), (10**6,)], "n long")
    assert [r[0] for r in sizes.select(display.circle_radius(F.col("n"))).collect()] == [3, 3, 5, 6, 21]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, small):
    from gridtally.sources.tables import incidents, offenses

    by = Filters(start=dt.date(1997, 1, 1), end=dt.date(1997, 12, 31), category="AF")
    plan = plan_of(filter_incidents(incidents(spark, small), offenses(spark, small), by).select("id"))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "LeftSemi" in plan and "o_totalprice" not in plan and "CartesianProduct" not in plan


def test_top_k_is_one_operator(spark, small):
    from gridtally.sources.tables import incidents

    plan = plan_of(grid.grid_aggregate(incidents(spark, small), 0.05))
    assert "TakeOrderedAndProject" in plan and "partial_count" in plan


def test_rollup_is_one_scan_per_shape(spark, small):
    from gridtally.sources.tables import incidents, offenses

    plan = plan_of(grid.build_rollup(incidents(spark, small), offenses(spark, small)))
    assert plan.count("orders.parquet") <= 4  # two shapes, both grids from the same scan
