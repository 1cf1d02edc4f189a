"""Readers for the input tables and the incident/offense views over them.

The provided star schema has no geography, so the incident domain is a set of
views: one incident per order, one offense per lineitem.  The arithmetic that
places an incident on the map is fixed here, once, for every query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_id, occurred_at, neighborhood, district, lon, lat (see SURVEY 7.4)."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    located = F.col("o_orderkey") % 97 != 0
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.lit("demo").alias("source_id"),
        F.col("o_orderdate").alias("occurred_at"),
        F.when(F.col("o_orderkey") % 41 != 0, F.col("c_nationkey").cast("string")).alias(
            "neighborhood"
        ),
        F.col("o_orderpriority").alias("district"),
        F.when(located, F.lit(-88.0) + (F.col("o_custkey") % 700) * F.lit(0.001)).alias("lon"),
        F.when(located, F.lit(41.6) + (F.col("o_orderkey") % 450) * F.lit(0.001)).alias("lat"),
    )


def offenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """incident_id, source_id, line, source_category (NULL for line 7)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("incident_id"),
        F.lit("demo").alias("source_id"),
        F.col("l_linenumber").alias("line"),
        F.when(
            F.col("l_linenumber") != 7, F.concat("l_returnflag", "l_linestatus")
        ).alias("source_category"),
    )


#: The same views for DuckDB; every oracle statement starts with this prefix.
VIEWS_SQL = """
WITH incident AS (
  SELECT o_orderkey AS id, 'demo' AS source_id, o_orderdate AS occurred_at,
         CASE WHEN o_orderkey % 41 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS neighborhood,
         o_orderpriority AS district,
         CASE WHEN o_orderkey % 97 <> 0
              THEN -88.0::DOUBLE + (o_custkey % 700) * 0.001::DOUBLE END AS lon,
         CASE WHEN o_orderkey % 97 <> 0
              THEN 41.6::DOUBLE + (o_orderkey % 450) * 0.001::DOUBLE END AS lat
  FROM orders JOIN customer ON o_custkey = c_custkey),
offense AS (
  SELECT l_orderkey AS incident_id, 'demo' AS source_id, l_linenumber AS line,
         CASE WHEN l_linenumber <> 7 THEN l_returnflag || l_linestatus END AS source_category
  FROM lineitem)
"""
