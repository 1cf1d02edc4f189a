"""Incident lists, counts, categories and data-set status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.operators.filters import checked_page

COUNT_CAP = 10_000


def page(found: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Latest first, undated last; ties by id, so pages never overlap."""
    limit, offset = checked_page(limit, offset)
    return found.orderBy(F.desc_nulls_last("occurred_at"), "id").offset(offset).limit(limit)


#: Spans of time that a deep page narrows down to, and the rows that are few enough to sort.
SPANS = ("year", "month", "day", "hour", "minute")
SORTED_ROWS = 10_000


def deep_page(found: DataFrame, limit: int = 100, offset: int = 0, most: int = SORTED_ROWS) -> DataFrame:
    """The rows of page(), for offsets of any size, without a sort of all rows before them.

    Rows are counted per year; the years before the page are skipped by their counts, and
    the year or two that the page lies in are counted per month, and so on, until few
    rows are left to be sorted.  Each step counts less than the one before.  What
    reaches the driver is a count per span: calendar years, or the parts of two spans.
    Undated rows are one span, the last.
    """
    limit, offset = checked_page(limit, offset)
    rows = found
    for span in SPANS:
        at = F.date_trunc(span, F.col("occurred_at")).alias("at")
        counts = rows.groupBy(at).agg(F.count("*").alias("n")).collect()
        counts.sort(key=lambda r: (r["at"] is None, -(r["at"].timestamp() if r["at"] else 0)))
        before, held = 0, []
        for r in counts:
            if before + r["n"] > offset and before < offset + limit:
                held.append((r["at"], r["n"], before))
            before += r["n"]
        if not held:
            return found.limit(0)
        dated = [at for at, _, _ in held if at is not None]
        within = F.lit(False) if dated else F.col("occurred_at").isNull()
        if dated:
            kind = found.schema["occurred_at"].dataType
            first, last = (F.lit(f(dated)).cast(kind) for f in (min, max))
            stop = last + F.expr(f"INTERVAL 1 {span}")
            within = (F.col("occurred_at") >= first) & (F.col("occurred_at") < stop)
            if len(dated) < len(held):
                within |= F.col("occurred_at").isNull()
        rows, offset = rows.where(within), offset - held[0][2]
        if sum(n for _, n, _ in held) <= most:
            break
    return rows.orderBy(F.desc_nulls_last("occurred_at"), "id").offset(offset).limit(limit)


def page_after(found: DataFrame, last: tuple, limit: int = 100) -> DataFrame:
    """The page after the row with the key last (occurred_at, id): a filter, whatever lies before."""
    checked_page(limit, 0)
    at, key = last
    later = F.col("id") > F.lit(key)
    if at is None:
        beyond = F.col("occurred_at").isNull() & later
    else:
        time = F.lit(at).cast(found.schema["occurred_at"].dataType)
        own = (F.col("occurred_at") == time) & later
        beyond = (F.col("occurred_at") < time) | own | F.col("occurred_at").isNull()
    return found.where(beyond).orderBy(F.desc_nulls_last("occurred_at"), "id").limit(limit)


def with_offenses(rows: DataFrame, offenses: DataFrame) -> DataFrame:
    """rows with their offenses nested, in a fixed order; an empty array for none.

    Only the page's own incidents meet the offense table.
    """
    nested = (
        offenses.join(rows.select(F.col("id").alias("incident_id")), "incident_id")
        .groupBy(F.col("incident_id").alias("id"))
        .agg(F.sort_array(F.collect_list(F.struct("line", "source_category"))).alias("offenses"))
    )
    none = F.array().cast(nested.schema["offenses"].dataType)
    return rows.join(nested, "id", "left").withColumn("offenses", F.coalesce("offenses", none))


def count(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("incident_count"))


def capped_count(found: DataFrame, cap: int = COUNT_CAP) -> DataFrame:
    """The exact count up to cap, which then means "at least"; stops scanning there."""
    return found.limit(cap).agg(F.count("*").alias("incident_count"))


def categories(offenses: DataFrame) -> DataFrame:
    known = offenses.where(F.col("source_category").isNotNull())
    return known.select("source_category").distinct().orderBy("source_category")


def incident_categories(offenses: DataFrame) -> DataFrame:
    """incident_id, categories: the distinct categories of each incident, sorted, blanks skipped."""
    known = offenses.where(F.coalesce("source_category", F.lit("")) != "")
    return known.groupBy("incident_id").agg(
        F.array_join(F.array_sort(F.collect_set("source_category")), ",").alias("categories")
    )


def categories_as_seen(offenses: DataFrame, order: str = "line") -> DataFrame:
    """incident_id, categories: the distinct categories of each incident, by where each is first seen.

    A category is one row per incident before they meet, so what meets is bounded by the
    number of categories.
    """
    known = offenses.where(F.coalesce("source_category", F.lit("")) != "")
    first = known.groupBy("incident_id", "source_category").agg(F.min(order).alias("at"))
    every = F.array_sort(F.collect_list(F.struct("at", "source_category")))
    shown = F.transform(every, lambda x: x["source_category"])
    return first.groupBy("incident_id").agg(F.array_join(shown, ",").alias("categories"))


def coverage(incidents: DataFrame) -> DataFrame:
    """First and last day per source."""
    return incidents.groupBy("source_id").agg(
        F.min("occurred_at").cast("date").alias("first_day"),
        F.max("occurred_at").cast("date").alias("last_day"),
    )


def offense_count(offenses: DataFrame) -> DataFrame:
    """Offenses per source; the source is a column of the offense, so nothing is joined."""
    return offenses.groupBy("source_id").agg(F.count("*").alias("offense_count"))


def status(incidents: DataFrame, offenses: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per source: coverage, exact counts, last completed run, any complete run."""
    history = runs.groupBy("source_id").agg(
        F.max(F.when(F.col("status") == "completed", F.col("completed_at"))).alias("last_run"),
        F.max(F.col("is_complete")).alias("is_complete"),
    )
    return (
        incidents.groupBy("source_id")
        .agg(
            F.count("*").alias("incident_count"),
            F.min("occurred_at").cast("date").alias("first_day"),
            F.max("occurred_at").cast("date").alias("last_day"),
        )
        .join(offense_count(offenses), "source_id", "full")
        .join(history, "source_id", "full")
        .select(
            "source_id",
            F.coalesce("incident_count", F.lit(0)).alias("incident_count"),
            F.coalesce("offense_count", F.lit(0)).alias("offense_count"),
            "first_day",
            "last_day",
            "last_run",
            F.coalesce("is_complete", F.lit(False)).alias("is_complete"),
        )
    )


def key_census(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct, null and blank values of a key, exactly."""
    text = F.trim(F.col(key).cast("string"))
    return df.agg(
        F.count("*").alias("total"),
        F.count_distinct(key).alias("distinct_keys"),
        F.count_if(F.col(key).isNull()).alias("null_keys"),
        F.count_if(text == "").alias("blank_keys"),
    )


def group_size_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many keys have n rows, for each n."""
    sizes = df.groupBy(key).agg(F.count("*").alias("rows_per_key"))
    return sizes.groupBy("rows_per_key").agg(F.count("*").alias("keys"))


def lookup(df: DataFrame, **key) -> DataFrame:
    """The row with the given key values, if any; a filter that is pushed down."""
    for name, value in key.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.limit(1)


def active_records(state: DataFrame, source_id: str) -> DataFrame:
    return state.where((F.col("source_id") == F.lit(source_id)) & F.col("source_active"))


def version_history(versions: DataFrame) -> DataFrame:
    """external_record_id, history: each record's versions in order of observation."""
    step = F.struct("observed_at", "run_id", "fingerprint")
    return versions.groupBy("source_id", "external_record_id").agg(
        F.sort_array(F.collect_list(step)).alias("history")
    )


def with_codes(offenses: DataFrame, codes: DataFrame) -> DataFrame:
    """offenses with code_name, the name of raw_offense_code among codes (code, name), if any.

    Codes are a reference table with a row for each code; Spark broadcasts it while
    its measured size is small and sorts both sides else.
    """
    named = codes.select(F.col("code").alias("raw_offense_code"), F.col("name").alias("code_name"))
    return offenses.join(named, "raw_offense_code", "left")
