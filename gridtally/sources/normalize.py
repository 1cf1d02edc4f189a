"""From raw city records to incidents and offenses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.functions.canonical import canonical_json
from gridtally.sources.schema import RAW

ZONE = "America/Chicago"
TIME_CONVENTION = "local_wall_clock"
#: The fields whose change makes a new version; touching updated_on alone does not.
FINGERPRINTED = [f for f in RAW.names if f != "updated_on"]


def local_to_utc(text: Column, zone: str = ZONE, repeated: str = "first") -> Column:
    """A wall-clock time with or without a fraction as an instant; anything else is null.

    A time that occurs twice when clocks go back means its first occurrence, as in the
    source's own convention; with repeated="last" its last one, as in DuckDB.
    """
    if repeated not in ("first", "last"):
        raise ValueError(repeated)
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss")
    parsed = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms))
    first = F.to_utc_timestamp(parsed, zone)
    if repeated == "first":
        return first
    # By the offset of a day later; it holds where it leads back to the same wall-clock time.
    moved = lambda x, n: F.timestamp_micros(F.unix_micros(x) + F.lit(n * 86_400_000_000))
    last = moved(F.to_utc_timestamp(moved(parsed, 1), zone), -1)
    return F.when(F.from_utc_timestamp(last, zone) == parsed, last).otherwise(first)


def lenient_double(text: Column) -> Column:
    """A number, or null for blank and unreadable text."""
    return text.try_cast("double")


def precision(lat: Column, lon: Column) -> Column:
    """Published places are shifted within their block; without one nothing is known."""
    located = lat.isNotNull() & lon.isNotNull()
    return F.when(located, F.lit("block")).otherwise(F.lit("unknown"))


def fingerprint(df: DataFrame, fields: list[str] | None = None) -> Column:
    """SHA-256 of the canonical JSON of the named fields; none named means all columns.

    A missing field counts as null.  Types are kept, so 1 and "1" differ.
    """
    names = fields or df.columns
    cells = [(F.col(n) if n in df.columns else F.lit(None).cast("string")).alias(n) for n in names]
    known = {f.name: f for f in df.schema}
    kind = T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])
    return F.sha2(canonical_json(F.struct(*cells), kind), 256)


def id_order(record: Column) -> Column:
    """A key that orders record ids as numbers; ids that are none come last, as text."""
    number = record.cast("string").try_cast("bigint")
    return F.struct(number.isNull().alias("text"), number.alias("number"), record.cast("string"))


def cursor_text(instant: Column) -> Column:
    """A time as the source writes it in a cursor, with milliseconds."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def iso_instant(text: Column) -> Column:
    """An ISO 8601 time as an instant; without an offset it is UTC, other text is null."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def row_id(*parts: Column) -> Column:
    """A deterministic id: retried tasks make the same one."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def normalize(raw: DataFrame, source_id: str) -> tuple[DataFrame, DataFrame]:
    """Incidents, one per case number, and offenses, one per record.

    Of several records of a case the one with the least id, as a number, describes
    the incident.  All its records stay offenses.
    """
    source = F.lit(source_id)
    lat, lon = lenient_double(F.col("latitude")), lenient_double(F.col("longitude"))
    # By the case number, of which the id is a digest: what moves is the raw fields.
    told = ["date", "latitude", "longitude", "block", "community_area", "district", "beat"]
    first = F.min_by(F.struct(*told), id_order(F.col("id"))).alias("_first")
    cases = raw.groupBy("case_number").agg(first).select("case_number", "_first.*")
    incidents = cases.select(
        row_id(source, F.col("case_number")).alias("id"),
        source.alias("source_id"),
        F.col("case_number").alias("external_incident_id"),
        local_to_utc(F.col("date")).alias("occurred_at"),
        F.col("date").alias("occurred_at_raw"),
        F.lit(TIME_CONVENTION).alias("source_time_convention"),
        lat.alias("lat"),
        lon.alias("lon"),
        precision(lat, lon).alias("location_precision"),
        F.col("block").alias("address_text"),
        F.col("community_area").alias("neighborhood"),
        "district",
        "beat",
    )
    return incidents, offenses_of(raw, source_id)


def offenses_of(raw: DataFrame, source_id: str, known: DataFrame | None = None) -> DataFrame:
    """The offenses of records; those of known offenses of the source stay with their incident.

    Records and known offenses meet by the record's id, before digests are made of it.
    """
    source = F.lit(source_id)
    incident_id = row_id(source, F.col("case_number"))
    if known is not None:
        own = known.where(F.col("source_id") == source).select(
            F.col("external_offense_id").alias("_record"), F.col("incident_id").alias("_incident")
        )
        raw = raw.join(own, F.col("id") == F.col("_record"), "left")
        incident_id = F.coalesce("_incident", incident_id)
    return raw.select(
        row_id(source, F.lit("offense"), F.col("id")).alias("id"),
        incident_id.alias("incident_id"),
        source.alias("source_id"),
        F.col("id").alias("external_offense_id"),
        F.col("iucr").alias("raw_offense_code"),
        "fbi_code",
        F.col("primary_type").alias("source_category"),
        F.col("description").alias("source_subcategory"),
        F.when(F.col("primary_type") == "HOMICIDE", F.lit(1)).alias("victim_count"),
    )


def insert_new_incidents(known: DataFrame, found: DataFrame, policy: str = "first_wins") -> DataFrame:
    """All incidents after a run.

    first_wins keeps what an incident first said; latest_wins replaces it.
    """
    if policy not in ("first_wins", "latest_wins"):
        raise ValueError(policy)
    keep, add = (known, found) if policy == "first_wins" else (found, known)
    fresh = add.join(keep.select("id"), "id", "left_anti")
    return keep.unionByName(fresh)


def merge_offenses(known: DataFrame, found: DataFrame) -> DataFrame:
    """Offenses after a run: found ones replace their descriptive fields, never their incident."""
    fixed = ("id", "incident_id", "source_id")
    seen = F.col("n.id").isNotNull()
    columns = [
        F.coalesce(f"k.{c}", f"n.{c}").alias(c)
        if c in fixed
        else F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"k.{c}")).alias(c)
        for c in known.columns
    ]
    joined = known.alias("k").join(found.alias("n"), F.col("k.id") == F.col("n.id"), "full")
    return joined.select(*columns)


def upsert_reference(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """A reference table with found rows put in or over; nothing is deleted."""
    return known.join(found.select(key), key, "left_anti").unionByName(found)
