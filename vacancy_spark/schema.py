"""Schemas and vocabulary of the vacancy event data."""

from __future__ import annotations

from pyspark.sql import types as T

# The only two event names that carry meaning.
CLICK = "job_visit"
APPLY = "job_apply_start"
REPORT_EVENTS = (CLICK, APPLY)

# Columns of the enriched event table read by the current report (12, in query order).
ENRICHED_COLUMNS = [
    "entity_id_str", "event_date_parsed", "event_name", "title_export", "organization_name",
    "location_region_matched", "occupational_fields_export", "importer_ID", "publishing_date",
    "expiration_date", "workflow_state", "upgrades",
]

# Enriched name -> report name (current app).
REPORT_RENAMES = {
    "entity_id_str": "entity_id",
    "event_date_parsed": "event_date",
    "title_export": "title",
    "location_region_matched": "uk_region",
    "occupational_fields_export": "occupational_fields",
    "publishing_date": "start_date",
    "expiration_date": "end_date",
}

# Columns dropped when the raw table is rebuilt with types.
TYPED_REBUILD_EXCLUDED = ["entity_subtype", "application_type", "current_user_id", "user_role", "site"]

JOB_METADATA_SCHEMA = T.StructType([
    T.StructField("entity_id", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("workflow_state", T.StringType()),
    T.StructField("occupational_fields", T.StringType()),
    T.StructField("locations", T.StringType()),
    T.StructField("publishing_date", T.TimestampNTZType()),
    T.StructField("expiration_date", T.TimestampNTZType()),
    T.StructField("organization_profile_name", T.StringType()),
    T.StructField("organization_id", T.StringType()),
    T.StructField("employment_type", T.StringType()),
    T.StructField("last_updated", T.TimestampNTZType()),
])

# The integer-date ranges of the range-partitioned table.
RANGE_START, RANGE_STOP, RANGE_STEP = 20200101, 20301231, 10000

# One CSV dialect for every reader and writer: a quote inside a quoted value is doubled, and
# white space belongs to the value. Quoted values may hold line feeds, so files are read whole
# (``multiLine``); writers therefore write many files, never one.
CSV_DIALECT = {"header": "true", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_READ = {**CSV_DIALECT, "multiLine": "true"}

# The job export file is read as text: its dates are day-first strings.
JOB_EXPORT_COLUMNS = [
    "job_id", "title", "workflow_state", "occupational_fields", "locations",
    "publishing_date", "expiration_date", "organization_profile_name",
]
JOB_EXPORT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in JOB_EXPORT_COLUMNS])

IMPORTER_MAPPING_SCHEMA = T.StructType([
    T.StructField("importer_id", T.StringType()),
    T.StructField("importer_name", T.StringType()),
])

