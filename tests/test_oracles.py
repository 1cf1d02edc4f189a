"""Every query with an oracle, side by side with DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gridtally.plans import registry


def compared(spark, name, queries, oracles, folder, tmp_path):
    out = str(tmp_path / "out")
    queries[name](spark, folder).write.parquet(out)
    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    db.execute(f"CREATE TABLE theirs AS {oracles[name]}")
    db.execute(f"CREATE VIEW ours AS SELECT * FROM '{out}/*.parquet'")
    shape = [sorted(r[:2] for r in db.execute(f"DESCRIBE {t}").fetchall()) for t in ("ours", "theirs")]
    assert shape[0] == shape[1]
    columns = ", ".join(f'"{c}"' for c, _ in shape[0])
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        left = db.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}")
        assert left.fetchall()[:3] == []


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, small, tmp_path, name):
    compared(spark, name, registry.queries(), registry.oracle_sql(), small, tmp_path)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["cell_x", "cell_y", "incident_count", "lon", "lat"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_geojson_leaves_out_unplaced(spark, small):
    from gridtally.sources.tables import incidents

    shown = registry.queries()["geojson_features"](spark, small)
    placed = incidents(spark, small).where("lon IS NOT NULL").count()
    assert shown.count() == placed
    assert '"type":"Point"' in shown.first()["feature"]


def test_times_about_changes_of_clocks(spark, tmp_path):
    """All hours of the days about two changes, so times that occur twice and times that never do."""
    duckdb.sql(
        f"""COPY (SELECT k AS o_orderkey, DATE '1996-10-25' + (k // 24)::INT + CASE WHEN k > 150 THEN 155 ELSE 0 END
        AS o_orderdate FROM range(1, 500) t(k)) TO '{tmp_path}/orders.parquet'"""
    )
    name = "timestamp_local_to_utc"
    compared(spark, name, registry.queries(), registry.oracle_sql(), str(tmp_path), tmp_path)


def test_labels_of_large_areas(spark, tmp_path):
    """An area of over 5,000 incidents, beyond the last stop that the SQL names."""
    sizes = {0: 9000, 1: 5100, 2: 600, 3: 60, 4: 2}
    places = " UNION ALL ".join(f"SELECT {c} AS c, unnest(range({n})) AS i" for c, n in sizes.items())
    for name, sql in {
        "customer": "SELECT c AS c_custkey, c AS c_nationkey FROM range(5) t(c)",
        "nation": "SELECT c AS n_nationkey, 'N' || c AS n_name FROM range(4) t(c)",
        "orders": f"""SELECT 41 * row_number() OVER () + 1 AS o_orderkey, c AS o_custkey,
            TIMESTAMP '1996-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM ({places})""",
        "lineitem": "SELECT 1 AS l_orderkey, 1 AS l_linenumber, 'A' AS l_returnflag, 'F' AS l_linestatus",
    }.items():
        duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
    compared(spark, "display_labels", registry.queries(), registry.oracle_sql(), str(tmp_path), tmp_path)
