"""Schemas of the incident domain and the check of a source against its contract."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


TYPES = {
    "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "INT": T.IntegerType(),
    "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "TIMESTAMP": T.TimestampType(),
}


def _struct(text: str) -> T.StructType:
    """A flat schema from "name TYPE, ..."; needs no session."""
    pairs = (field.split() for field in text.split(","))
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


#: A raw record as the source publishes it: every value is text or a flag.
RAW = _struct(
    "id STRING, case_number STRING, date STRING, block STRING, iucr STRING, primary_type STRING,"
    " description STRING, location_description STRING, arrest BOOLEAN, domestic BOOLEAN,"
    " beat STRING, district STRING, ward STRING, community_area STRING, fbi_code STRING,"
    " updated_on STRING, latitude STRING, longitude STRING"
)

INCIDENT = _struct(
    "id STRING, source_id STRING, external_incident_id STRING, occurred_at TIMESTAMP,"
    " occurred_at_raw STRING, source_time_convention STRING, lat DOUBLE, lon DOUBLE,"
    " location_precision STRING, address_text STRING, neighborhood STRING, district STRING,"
    " beat STRING"
)

OFFENSE = _struct(
    "id STRING, incident_id STRING, source_id STRING, external_offense_id STRING,"
    " raw_offense_code STRING, fbi_code STRING, source_category STRING,"
    " source_subcategory STRING, victim_count INT"
)

SOURCE_RECORD = _struct(
    "source_id STRING, external_record_id STRING, source_active BOOLEAN, first_seen_at TIMESTAMP,"
    " last_seen_at TIMESTAMP, source_removed_at TIMESTAMP, removal_confidence STRING,"
    " consecutive_missing_runs INT, current_fingerprint STRING"
)

#: What a run says of a record it has fetched.
FETCHED = _struct("external_record_id STRING, fingerprint STRING")

VERSION = _struct(
    "source_id STRING, external_record_id STRING, run_id STRING, fingerprint STRING,"
    " payload STRING, observed_at TIMESTAMP"
)

RUN = _struct(
    "run_id STRING, source_id STRING, started_at TIMESTAMP, completed_at TIMESTAMP,"
    " status STRING, records_received BIGINT, records_created BIGINT, records_changed BIGINT,"
    " records_unchanged BIGINT, records_missing BIGINT, is_complete BOOLEAN,"
    " plausibility_status STRING, blocking_reason STRING, deletion_evidence_allowed BOOLEAN,"
    " baseline_count_at_run BIGINT, percent_change_from_baseline DOUBLE, error_message STRING"
)

# The words that status columns may hold.
RUN_STATUS = ("running", "completed", "partial", "failed")
REMOVAL_CONFIDENCE = ("none", "pending", "likely", "confirmed")
LOCATION_PRECISION = ("exact", "approximate", "block", "intersection", "suppressed", "unknown")


@dataclass(frozen=True)
class Contract:
    """What a source must, may and need not offer; types by field where they matter."""

    required: frozenset[str]
    optional: frozenset[str] = frozenset()
    ignored: frozenset[str] = frozenset()
    types: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class SchemaReport:
    """Missing and retyped fields make a source invalid; new ones are only reported."""

    missing: tuple[str, ...]
    retyped: tuple[str, ...]
    unknown: tuple[str, ...]

    @property
    def valid(self) -> bool:
        return not self.missing and not self.retyped


def check_schema(offered: T.StructType | dict[str, str], contract: Contract) -> SchemaReport:
    """Compare a schema, or a mapping of fields to types, with the contract."""
    if isinstance(offered, T.StructType):
        offered = {f.name: f.dataType.simpleString() for f in offered}
    known = contract.required | contract.optional | contract.ignored
    return SchemaReport(
        tuple(sorted(contract.required - offered.keys())),
        tuple(sorted(f for f, t in contract.types.items() if f in offered and offered[f] != t)),
        tuple(sorted(offered.keys() - known)),
    )


CITY_CONTRACT = Contract(
    frozenset({"id", "case_number", "date", "updated_on", "iucr", "primary_type"}),
    frozenset(RAW.names) - {"id", "case_number", "date", "updated_on", "iucr", "primary_type"},
    frozenset({"x_coordinate", "y_coordinate", "year", "location"}),
    {"id": "string", "date": "string", "updated_on": "string", "arrest": "boolean"},
)
