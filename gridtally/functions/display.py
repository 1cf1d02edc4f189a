"""Column functions for what a client shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Incident counts and the radius of their map circle in pixels.
RADIUS_STOPS = [
    (1, 3.0), (50, 5.0), (500, 7.0), (5000, 9.0),
    (50_000, 12.0), (150_000, 15.0), (350_000, 18.0), (700_000, 21.0),
]


def category_label(category: Column) -> Column:
    return F.coalesce(category, F.lit("Unknown"))


def area_label(code: Column, name: Column) -> Column:
    """"Name (code)", "Unknown (code)", or a dash without a code."""
    known = F.concat(F.coalesce(name, F.lit("Unknown")), F.lit(" ("), code, F.lit(")"))
    return F.when(code.isNull(), F.lit("—")).otherwise(known)


def percent_label(change: Column) -> Column:
    """Signed, with one decimal; a dash without a value."""
    sign = F.when(change > 0, F.lit("+")).otherwise(F.lit(""))
    text = F.concat(sign, F.format_number(change, 1), F.lit("%"))
    return F.when(change.isNull(), F.lit("—")).otherwise(text)


def calendar_label(day: Column) -> Column:
    """A calendar date as "Jan 1, 2001", the same everywhere; "unknown" without one."""
    return F.coalesce(F.date_format(day.cast("date"), "MMM d, yyyy"), F.lit("unknown"))


def bar_width(df: DataFrame, value: str) -> DataFrame:
    """df with bar_width: percent of the largest value, visible at least."""
    most = F.greatest(F.max(value).over(Window.partitionBy()), F.lit(1))
    return df.withColumn("bar_width", F.greatest(F.col(value) / most * 100, F.lit(2.0)))


def circle_radius(
    count: Column, stops: list[tuple[int, float]] = RADIUS_STOPS, goes_on: bool = False
) -> Column:
    """Piecewise linear between the stops, flat outside; or beyond the last the last slope goes on."""
    (low, radius), *rest = stops
    found = F.when(count <= low, F.lit(radius))
    for high, wider in rest:
        slope = (wider - radius) / (high - low)
        between = (count - low) * slope + radius
        found = found.when(count <= high, between)
        low, radius = high, wider
    return found.otherwise(between) if goes_on else found.otherwise(F.lit(radius))


def geojson_points(df: DataFrame, properties: list[str]) -> DataFrame:
    """feature: a GeoJSON point of each row that has a place."""
    return df.where("lon IS NOT NULL AND lat IS NOT NULL").select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(
                    F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")
                ).alias("geometry"),
                F.struct(*properties).alias("properties"),
            )
        ).alias("feature")
    )


def feature_collection(features: DataFrame) -> DataFrame:
    """collection: one GeoJSON collection of features (feature), for one page or one map grid.

    A page has a limit and a grid a bounded number of cells; a whole table stays
    a table of features.
    """
    listed = F.array_join(F.sort_array(F.collect_list("feature")), ",")
    head, tail = F.lit('{"type":"FeatureCollection","features":['), F.lit("]}")
    return features.agg(F.concat(head, listed, tail).alias("collection"))
