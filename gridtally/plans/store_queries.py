"""Queries through the store, its streams and its layout, over snapshots of the orders table.

Each works in a folder of its own, writes its answer beside it and deletes the folder.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from gridtally.functions.canonical import canonical_json
from gridtally.operators import grid, listing
from gridtally.operators.filters import Box, Filters, filter_incidents
from gridtally.operators.reconcile import SourceConfig, judged
from gridtally.plans.reconcile_queries import FIRST, SECOND, SQL_SNAPSHOTS, snapshots
from gridtally.sources import clustered, tables
from gridtally.sources.changes import change_stream, lay_out
from gridtally.sources.schema import INCIDENT, OFFENSE, RAW
from gridtally.sources.state import SnapshotStore, work_folder
from gridtally.streaming import incremental, keyed, resumable

API = "gridtally.sources.changes:OrderedApi"
#: Cells of the store layout at the size of the test tables.
SLABS, TILES = 8, 8
WIDE = Box(-88.0005, 41.7, -87.3005, 41.95, geodesic=True)
RAW_FORM = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW)


class Home:
    """A folder for one query's store, gone once its answer is written."""

    def __init__(self, spark):
        self.spark, self.path = spark, f"{work_folder(spark)}/query-{uuid.uuid4().hex}"
        self.store = SnapshotStore(spark, f"{self.path}/store")

    def __enter__(self):
        return self

    def answer(self, df):
        """df, written where it outlives the folder."""
        path = f"{self.path}-answer"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_):
        self.store._fs.delete(self.store._path(self.path), True)


def raw_orders(orders, category="o_orderpriority", case="o_custkey"):
    """Orders as raw records; the order date is both when it happened and when it was updated."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    known = {
        "id": F.col("o_orderkey").cast("string"),
        "case_number": F.col(case).cast("string"),
        "date": text,
        "updated_on": text,
        "iucr": F.lit("0110"),
        "primary_type": F.col(category),
    }
    return orders.select(*(known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in RAW))


SQL_STATE = SQL_SNAPSHOTS + """
SELECT coalesce(f.external_record_id, b.external_record_id) AS external_record_id,
       true AS source_active,
       CASE WHEN f.external_record_id IS NULL THEN 'pending' ELSE 'none' END AS removal_confidence,
       CASE WHEN f.external_record_id IS NULL THEN 1 ELSE 0 END AS consecutive_missing_runs,
       CASE WHEN b.external_record_id IS NULL THEN DATE '2024-01-02' ELSE DATE '2024-01-01' END
         AS first_seen, CASE WHEN f.external_record_id IS NULL THEN DATE '2024-01-01'
         ELSE DATE '2024-01-02' END AS last_seen
FROM before b FULL JOIN fetched f USING (external_record_id)"""


SHOWN_STATE = [
    "external_record_id", "source_active", "removal_confidence", "consecutive_missing_runs",
    "first_seen_at", "last_seen_at",
]


def shown_state(state):
    return state.select(
        "external_record_id",
        "source_active",
        "removal_confidence",
        "consecutive_missing_runs",
        F.col("first_seen_at").cast("date").alias("first_seen"),
        F.col("last_seen_at").cast("date").alias("last_seen"),
    )


class Stopped(Exception):
    pass


def stop_after(last: int):
    def check(part: int) -> None:
        if part == last:
            raise Stopped

    return check


def taken_up(store, raw, config, parts: int = 4):
    """A complete run that is stopped after its second part and then goes on."""
    size = max(1, -(-raw.count() // parts))
    try:
        resumable.complete_in_parts(
            store, raw, config, "r2", SECOND, part_records=size, after_part=stop_after(1)
        )
    except Stopped:
        pass
    return resumable.complete_in_parts(store, raw, config, "r3", SECOND + dt.timedelta(days=30))


def register(query, page_sql: str, rollup_sql: str):
    @query("resumed_run_state", SQL_STATE)
    def resumed_run_state(spark, sf_dir):
        """The state after a complete run that was stopped between its parts and taken up."""
        orders = tables.table(spark, sf_dir, "orders")
        changed = F.when(F.col("o_orderkey") % 7 == 0, "CHANGED").otherwise(F.col("o_orderpriority"))
        with Home(spark) as home:
            config = SourceConfig("demo")
            before = raw_orders(orders.where("o_orderkey % 13 <> 0"))
            incremental.full_run(home.store, before, config, "r1", FIRST)
            after = raw_orders(orders.where("o_orderkey % 10 <> 0").withColumn("o_orderpriority", changed))
            taken_up(home.store, after, config)
            return home.answer(shown_state(home.store.read("source_records", columns=SHOWN_STATE)))

    @query(
        "resumed_run_counters",
        SQL_SNAPSHOTS + """
SELECT 'r2' AS run_id, 'completed' AS status, count(*) AS records_received,
       count(*) FILTER (kind = 'created') AS records_created,
       count(*) FILTER (kind = 'changed') AS records_changed,
       count(*) FILTER (kind = 'unchanged') AS records_unchanged,
       (SELECT count(*) FROM before WHERE external_record_id NOT IN
         (SELECT external_record_id FROM fetched)) AS records_missing
FROM outcome""",
    )
    def resumed_run_counters(spark, sf_dir):
        """The journal's row of such a run: the counters of one that never stopped."""
        orders = tables.table(spark, sf_dir, "orders")
        changed = F.when(F.col("o_orderkey") % 7 == 0, "CHANGED").otherwise(F.col("o_orderpriority"))
        with Home(spark) as home:
            config = SourceConfig("demo")
            incremental.full_run(home.store, raw_orders(orders.where("o_orderkey % 13 <> 0")), config, "r1", FIRST)
            after = raw_orders(orders.where("o_orderkey % 10 <> 0").withColumn("o_orderpriority", changed))
            taken_up(home.store, after, config)
            kinds = [f"records_{c}" for c in ("received", "created", "changed", "unchanged", "missing")]
            runs = home.store.read("runs").where("run_id <> 'r1'")
            return home.answer(runs.select("run_id", "status", *kinds))

    @query("keyed_stream_state", SQL_STATE)
    def keyed_stream_state(spark, sf_dir):
        """The state that a keyed stream holds after two runs, the second after a restart."""
        seen = "external_record_id string, fingerprint string, run_at timestamp"
        with Home(spark) as home:
            for rows, at in zip(snapshots(spark, sf_dir), (FIRST, SECOND), strict=True):
                run = rows.select("external_record_id", "fingerprint", F.lit(at).cast("timestamp").alias("run_at"))
                run.write.mode("append").parquet(f"{home.path}/runs")
                stream = spark.readStream.schema(seen).parquet(f"{home.path}/runs")
                keyed.follow(stream, home.store, "demo", f"{home.path}/checkpoint", dt.timedelta(days=1))
            return home.answer(shown_state(home.store.read("source_records", columns=SHOWN_STATE)))

    @query(
        "change_stream_records",
        "SELECT o_orderkey::VARCHAR AS external_offense_id, o_orderpriority AS source_category FROM orders",
    )
    def change_stream_records(spark, sf_dir):
        """Orders as a source that is followed by its cursor, stopped in the midst of a time."""
        orders = tables.table(spark, sf_dir, "orders")
        with Home(spark) as home:
            shown = raw_orders(orders).select("id", "case_number", "date", "updated_on", "iucr", "primary_type")
            lay_out(shown, f"{home.path}/table")
            count = orders.count()
            for limit in (count // 3, count):
                home.store._put_text(f"{home.path}/limit-{limit}", str(limit))
                stream = change_stream(
                    spark, API, RAW_FORM, table=f"{home.path}/table", limit=f"{home.path}/limit-{limit}",
                    taskRows=str(max(1000, count // 8)),
                )
                incremental.run_stream(
                    stream, home.store, SourceConfig("demo"), f"{home.path}/checkpoint", "demo@changes", FIRST
                )
            return home.answer(home.store.read("offenses", columns=["external_offense_id", "source_category"]))

    def stored_incidents(spark, sf_dir, home):
        """The incidents of the views in a store, clustered."""
        rows = tables.incidents(spark, sf_dir)
        known = {"id": F.col("id").cast("string"), **{c: F.col(c) for c in rows.columns if c != "id"}}
        shape = [known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INCIDENT]
        home.store.commit(merged={"incidents": (rows.select(*shape), ["id"])})
        clustered.cluster_incidents(home.store, SLABS, TILES)
        return home.store.pointer()

    columns = ["id", "neighborhood", "district"]
    box = Box(-87.66, 41.8, -87.6, 41.85)

    @query(
        "box_from_clustered",
        "SELECT id::VARCHAR AS id, neighborhood, district FROM incident WHERE"
        " lon BETWEEN -87.66::DOUBLE AND -87.6::DOUBLE AND lat BETWEEN 41.8::DOUBLE AND 41.85::DOUBLE",
    )
    def box_from_clustered(spark, sf_dir):
        """A box answered from the files whose bounds meet it."""
        with Home(spark) as home:
            pointer, by = stored_incidents(spark, sf_dir, home), Filters(box=box)
            rows = clustered.incidents_for(home.store, pointer, by)
            none = spark.createDataFrame([], OFFENSE)
            return home.answer(filter_incidents(rows, none, by).select(*columns))

    @query(
        "page_from_clustered",
        "SELECT id::VARCHAR AS id, neighborhood, district FROM incident"
        " ORDER BY occurred_at DESC NULLS LAST, id::VARCHAR LIMIT 100 OFFSET 200",
    )
    def page_from_clustered(spark, sf_dir):
        """A page of the list from the files of the latest slabs."""
        with Home(spark) as home:
            pointer = stored_incidents(spark, sf_dir, home)
            none = spark.createDataFrame([], OFFENSE)
            found = clustered.latest_page(home.store, pointer, Filters(), none, 100, 200)
            return home.answer(found.select(*columns))

    @query("incident_page_deep", page_sql.format(limit=100, offset=10_000))
    def incident_page_deep(spark, sf_dir):
        """A page far down: spans of time before it are counted, not sorted."""
        shown = ["id", "occurred_at", "neighborhood", "district"]
        return listing.deep_page(tables.incidents(spark, sf_dir), 100, 10_000).select(*shown)

    @query(
        "incident_page_after",
        page_sql.replace("WHERE true", "WHERE occurred_at < TIMESTAMP '1996-01-01'").format(limit=100, offset=0),
    )
    def incident_page_after(spark, sf_dir):
        """The page after a key; this one is before all records of its time."""
        shown = ["id", "occurred_at", "neighborhood", "district"]
        key = (dt.datetime(1996, 1, 1), 2**62)
        return listing.page_after(tables.incidents(spark, sf_dir), key).select(*shown)

    @query(
        "filter_bbox_geodesic",
        f"""
, bent AS (
  SELECT *, degrees(atan(tan(radians({WIDE.south})) * cos(radians(lon - ({WIDE.west + WIDE.east}) / 2))
                         / cos(radians({WIDE.east - WIDE.west}) / 2))) AS low,
         degrees(atan(tan(radians({WIDE.north})) * cos(radians(lon - ({WIDE.west + WIDE.east}) / 2))
                      / cos(radians({WIDE.east - WIDE.west}) / 2))) AS high FROM incident)
SELECT id, neighborhood, district FROM bent
WHERE lon BETWEEN {WIDE.west}::DOUBLE AND {WIDE.east}::DOUBLE AND lat >= low AND lat <= high""",
    )
    def filter_bbox_geodesic(spark, sf_dir):
        """A box whose upper and lower edges are great-circle arcs."""
        by = Filters(box=WIDE)
        rows = tables.incidents(spark, sf_dir)
        return filter_incidents(rows, tables.offenses(spark, sf_dir), by).select("id", "neighborhood", "district")

    @query(
        "canonical_digests",
        r"""
SELECT o_orderkey, sha256('{"case":{"id":' || o_custkey || ',"kind":"' || o_orderpriority || '"},"flag":' ||
         CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"note":"caf\u00e9 \ud83d\ude00 ' || o_orderkey ||
         '\n","parts":["\"a\\b\"",' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderkey || '"' END || ']}')
       AS digest FROM orders""",
    )
    def canonical_digests(spark, sf_dir):
        """Digests of nested records with escapes; the oracle has their JSON spelt out."""
        key = F.col("o_orderkey")
        record = F.struct(
            F.array(F.lit('"a\\b"'), F.when(key % 3 != 0, key.cast("string"))).alias("parts"),
            F.concat(F.lit("café \U0001f600 "), key.cast("string"), F.lit("\n")).alias("note"),
            F.struct(F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("id")).alias("case"),
            (key % 2 == 0).alias("flag"),
        ).alias("record")
        rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", record)
        text = canonical_json(F.col("record"), rows.schema["record"].dataType)
        return rows.select("o_orderkey", F.sha2(text, 256).alias("digest"))

    @query(
        "rollup_after_increments",
        rollup_sql + "SELECT source_id, grid, round(cell_lon, 6) AS cell_lon, round(cell_lat, 6) AS cell_lat,"
        " month, category, n, round(mean_lon + 1e-9::DOUBLE, 6) AS mean_lon,"
        " round(mean_lat + 1e-9::DOUBLE, 6) AS mean_lat FROM rollup_rows",
    )
    def rollup_after_increments(spark, sf_dir):
        """The pre-aggregate of part of the data, brought up to date by three increments.

        The first part holds a fifth of the incidents in other places and other categories of
        some offenses; the increments move, correct and add.
        """
        incidents, offenses = tables.incidents(spark, sf_dir), tables.offenses(spark, sf_dir)
        turn = F.col("id") % 4
        moved = F.when(F.col("id") % 5 == 0, F.col("lon") + F.lit(0.25)).otherwise(F.col("lon"))
        wrong = F.when(F.col("incident_id") % 6 == 0, "OLD").otherwise(F.col("source_category"))
        old = incidents.withColumn("lon", moved), offenses.withColumn("source_category", wrong)
        first = (turn != 1), (F.col("incident_id") % 4 != 1)
        parts = grid.rollup_parts(old[0].where(first[0]), old[1].where(first[1]))
        for n in (1, 2, 3):
            own, theirs = turn == n, F.col("incident_id") % 4 == n
            before = old[0].where(own & first[0]), old[1].where(theirs & first[1])
            after = incidents.where(own), offenses.where(theirs)
            parts = parts.unionByName(grid.rollup_delta(before, after))
        rest = old[0].where(turn == 0), old[1].where(F.col("incident_id") % 4 == 0)
        last = incidents.where(turn == 0), offenses.where(F.col("incident_id") % 4 == 0)
        parts = parts.unionByName(grid.rollup_delta(rest, last))
        centres = {c: F.round(c, 6) for c in ("cell_lon", "cell_lat")}
        means = {c: grid.steady(F.col(c)) for c in ("mean_lon", "mean_lat")}
        return grid.with_means(parts).withColumns(centres | means)

    @query(
        "plausibility_table",
        """
, counted AS (
  SELECT left(o_orderpriority, 1)::INT AS k, count(*) AS was, count(*) FILTER (o_orderkey % 3 <> 0) AS received
  FROM orders GROUP BY ALL)
SELECT k AS source, received,
       CASE WHEN k = 1 OR k = 4 THEN 'plausible' ELSE 'suspicious' END AS status,
       CASE k WHEN 2 THEN 'source_count_mismatch' WHEN 3 THEN 'record_count_drop_exceeds_threshold'
              WHEN 5 THEN 'manual_safety_hold' END AS reason, k = 1 OR k = 4 AS evidence
FROM counted""",
    )
    def plausibility_table(spark, sf_dir):
        """Runs that bring two thirds of the orders, judged by source, each with its own bounds."""
        orders = tables.table(spark, sf_dir, "orders")
        source = F.left("o_orderpriority", F.lit(1)).cast("int").alias("source")
        runs = orders.groupBy(source).agg(
            F.count("*").alias("baseline"), F.count_if(F.col("o_orderkey") % 3 != 0).alias("received")
        )
        k = F.col("source")
        told = runs.withColumns(
            {
                "reported": F.when(k == 2, F.col("baseline")),
                "floor": F.when(k != 2, F.lit(1)),
                "most_drop_percent": F.when(k == 1, 60.0).when(k == 3, 10.0),
                "manual_hold": k == 5,
                "protected": k != 4,
                "schema_valid": F.lit(True),
            }
        )
        return judged(told).select("source", "received", "status", "reason", "evidence")
