"""Period summaries: comparison, breakdown, series and top areas."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.operators import grid
from gridtally.operators.filters import Filters, checked_range, filter_incidents, in_days

DEFAULT_DAYS = 30
LONGEST_WEEKLY = 60
AREA_LIMIT = 10


@dataclass(frozen=True)
class Period:
    """A span of days, both ends in it, the span before it, and how series are cut."""

    start: dt.date
    end: dt.date
    clamped: bool
    bucket: str

    @property
    def before(self) -> tuple[dt.date, dt.date]:
        end = self.start - dt.timedelta(days=1)
        return end - (self.end - self.start), end


def resolve_period(
    start: dt.date | None, end: dt.date | None, latest: dt.date, strict: bool = False
) -> Period:
    """Fill in what is missing from the latest day of data, and stop there.

    Both defaults count from the latest day, so an early end alone gives a
    period that ends before it starts; strict refuses that.
    """
    given_end = latest if end is None else end
    first = latest - dt.timedelta(days=DEFAULT_DAYS) if start is None else start
    last = min(given_end, latest)
    if strict:
        checked_range(first, last)
    bucket = "week" if (last - first).days <= LONGEST_WEEKLY else "month"
    return Period(first, last, given_end > latest, bucket)


def percent_change(now: int, before: int) -> float | None:
    """To one decimal, as Python rounds; None without a base."""
    return round((now - before) / before * 100, 1) if before else None


def one_decimal(x: Column) -> Column:
    """x to one decimal as Python rounds: by the exact value of x, and to even where that is a tie.

    20 x is compared with the odd number between its neighbours.  Near a tie both
    differences are exact.
    """
    below = F.floor(x * 10).cast("double")
    tie = below * 2 + 1
    over = (x * 16 - tie) + x * 4
    even = below % 2 == 0
    up = (over > 0) | ((over == 0) & ~even)
    return F.when(up, below + 1).otherwise(below) / 10


def latest_day(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.max("occurred_at").cast("date").alias("latest"))


def compare(found: DataFrame, period: Period) -> DataFrame:
    """Counts of the period and the one before in one pass, and the change in percent."""
    day = F.col("occurred_at").cast("date")
    earlier = period.before
    rows = in_days(found, min(earlier[0], period.start), max(period.end, earlier[1]))
    counted = rows.agg(
        F.count_if(day.between(F.lit(period.start), F.lit(period.end))).alias("current_count"),
        F.count_if(day.between(*map(F.lit, earlier))).alias("previous_count"),
    )
    now, before = F.col("current_count"), F.col("previous_count")
    return counted.withColumn(
        "percent_change", F.when(before != 0, one_decimal((now - before) / before * 100))
    )


def breakdown(found: DataFrame, offenses: DataFrame, limit: int = grid.CATEGORY_LIMIT) -> DataFrame:
    """Offenses of the found incidents per category; no category is a group too.

    found may itself be limited to a category: the other categories of those
    incidents still show.
    """
    pairs = offenses.join(found.select(F.col("id").alias("incident_id")), "incident_id")
    counted = pairs.groupBy(F.col("source_category").alias("category")).agg(
        F.count("*").alias("offense_count")
    )
    return counted.orderBy(F.desc("offense_count"), F.asc_nulls_first("category")).limit(limit)


def bucket_end(bucket: Column, kind: str) -> Column:
    return F.date_add(bucket, 6) if kind == "week" else F.last_day(bucket)


def series(found: DataFrame, kind: str, latest: dt.date | None = None) -> DataFrame:
    """Counts per ISO week or month that has any.

    With latest, is_partial tells whether the last bucket ends after it.
    """
    dated = found.where(F.col("occurred_at").isNotNull())
    counted = dated.groupBy(
        F.date_trunc(kind, "occurred_at").cast("date").alias("bucket_start")
    ).agg(F.count("*").alias("incident_count"))
    if latest is not None:
        last = counted.agg(F.max("bucket_start").alias("last_bucket"))
        counted = counted.join(
            last, F.col("bucket_start") == F.col("last_bucket"), "left"
        ).select(
            "bucket_start",
            "incident_count",
            (
                F.col("last_bucket").isNotNull()
                & (bucket_end(F.col("bucket_start"), kind) > F.lit(latest))
            ).alias("is_partial"),
        )
    return counted.orderBy("bucket_start")


def top_areas(found: DataFrame, names: DataFrame | None = None, limit: int = AREA_LIMIT) -> DataFrame:
    """Most frequent areas; with names (code, name), the name or null for an unknown code."""
    counted = (
        found.where(F.col("neighborhood").isNotNull())
        .groupBy("neighborhood")
        .agg(F.count("*").alias("incident_count"))
        .orderBy(F.desc("incident_count"), "neighborhood")
        .limit(limit)
    )
    if names is None:
        return counted
    named = names.select(F.col("code").alias("neighborhood"), F.col("name").alias("area_name"))
    return counted.join(named, "neighborhood", "left")


@dataclass
class Summary:
    period: Period
    current: int
    previous: int
    change: float | None
    buckets: DataFrame
    categories: DataFrame
    areas: DataFrame
    breakdown_by: str


def summarise(
    incidents: DataFrame,
    offenses: DataFrame,
    rollup: DataFrame | None,
    by: Filters,
    names: DataFrame | None = None,
    today: dt.date | None = None,
    strict: bool = False,
) -> Summary:
    """The whole summary of a source; only scalars are computed at once.

    Every part honours every filter.  The breakdown comes from the pre-aggregate
    if no filter needs incidents and the period is whole months.
    """
    own = incidents if by.source_id is None else incidents.where(F.col("source_id") == by.source_id)
    latest = latest_day(own).first()["latest"] or today or dt.date.today()
    period = resolve_period(by.start, by.end, latest, strict)
    unbounded = filter_incidents(incidents, offenses, replace(by, start=None, end=None))
    found = in_days(unbounded, period.start, period.end)
    counts = compare(unbounded, period).first()
    by_rollup = (
        rollup is not None
        and by.category is None
        and by.neighborhood is None
        and by.district is None
        and by.box is None
        and grid.whole_months(period.start, period.end)
    )
    if by_rollup:
        own_rollup = rollup
        if by.source_id is not None:
            own_rollup = rollup.where(F.col("source_id") == F.lit(by.source_id))
        parts = grid.rollup_breakdown(own_rollup, period.start, period.end)
    else:
        parts = breakdown(found, offenses)
    now, before = counts["current_count"], counts["previous_count"]
    return Summary(
        period,
        now,
        before,
        percent_change(now, before),
        series(found, period.bucket, latest),
        parts,
        top_areas(found, names),
        "rollup" if by_rollup else "raw",
    )
