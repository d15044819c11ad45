"""Joins between events and job metadata.

All joins are equi-joins on the vacancy key. The metadata side is one row per vacancy (tens
of thousands of rows in the reference's deployment) but is not assumed small: Spark plans a
broadcast only when its measured size is under the broadcast threshold (statically, or
at run time through AQE), and a shuffle join with skew splitting otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import REPORT_EVENTS
from .regions import add_region_column

# Metadata column -> name in the joined event table.
METADATA_ALIASES = [
    ("title", "title"),
    ("workflow_state", "workflow_state"),
    ("occupational_fields", "occupational_fields"),
    ("locations", "location_full"),
    ("publishing_date", "start_date"),
    ("expiration_date", "end_date"),
    ("organization_profile_name", "organization_name_jobiqo"),
    ("employment_type", "employment_type"),
]
EVENT_COLUMNS = ["entity_id", "event_name", "event_date", "organization_name", "regions",
                 "upgrades", "importer_id"]

# Job-export columns kept by the merge and their new names.
EXPORT_RENAMES = [
    ("publishing_date", "start_date"),
    ("expiration_date", "end_date"),
    ("organization_profile_name", "organization_name_jobiqo"),
    ("locations", "location_full"),
]
EXPORT_KEEP = ["entity_id", "title", "publishing_date", "expiration_date",
               "organization_profile_name", "locations"]


def join_metadata(events: DataFrame, meta: DataFrame, order: bool = True) -> DataFrame:
    """Clicks and applies LEFT JOIN metadata on the vacancy id, newest day first."""
    e = events.where(F.col("event_name").isin(*REPORT_EVENTS)).alias("e")
    m = meta.alias("m")
    cols = [F.col(f"e.{c}") for c in EVENT_COLUMNS if c in events.columns]
    cols += [F.col(f"m.{src}").alias(dst) for src, dst in METADATA_ALIASES if src in meta.columns]
    out = e.join(m, F.col("e.entity_id") == F.col("m.entity_id"), "left").select(*cols)
    return newest_first(out) if order else out


def newest_first(df: DataFrame, date_col: str = "event_date") -> DataFrame:
    """Global sort, newest day first. Rows of one day are further ordered by vacancy and a
    hash of the whole row: the reference leaves them unordered, and the extra keys let the
    range partitioner split a day holding a large share of all rows over many tasks."""
    keys = [F.col(date_col).desc()]
    if "entity_id" in df.columns:
        keys.append(F.col("entity_id").asc_nulls_first())
    keys.append(F.xxhash64(*[F.col(c) for c in df.columns]))
    return df.orderBy(*keys)


def export_rows(export: DataFrame, taken, entity: str = "entity_id") -> DataFrame:
    """The export's columns as the merge names them; a name in ``taken`` gets a suffix."""
    x = export.withColumnRenamed("job_id", entity) if "job_id" in export.columns else export
    x = x.select(*[c for c in EXPORT_KEEP if c in x.columns]).withColumnsRenamed(dict(EXPORT_RENAMES))
    x = x.withColumn(entity, F.col(entity).cast("string"))
    return x.withColumnsRenamed({c: f"{c}_from_jobiqo" for c in x.columns if c != entity and c in taken})


def merge_job_export(df: DataFrame, export: DataFrame, regions: bool = False) -> DataFrame:
    """Events LEFT JOIN the job export on ``job_id`` (renamed ``entity_id``): six columns, four
    renamed; a name already in ``df`` gets the suffix ``_from_jobiqo``. ``regions`` adds
    ``uk_region``, parsed once per export row; without a match it is ``'Unknown'``."""
    if "entity_id" not in df.columns or not {"entity_id", "job_id"} & set(export.columns):
        return df
    x = export_rows(export, df.columns)
    if not regions:
        return df.join(x, "entity_id", "left")
    if "location_full" not in x.columns:
        return add_region_column(df.join(x, "entity_id", "left"))
    out = df.join(add_region_column(x), "entity_id", "left")
    return out.withColumn("uk_region", F.coalesce("uk_region", F.lit("Unknown")))


def _keys_of_both(events: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Per key: number of events and whether the metadata has it. The sides are put under each
    other, not joined, so every task adds up its own rows before the one shuffle."""
    both = events.select(F.col(key).alias("key"), F.lit(1).alias("n"), F.lit(0).alias("known")).unionAll(
        meta.select(F.col(key).alias("key"), F.lit(0), F.lit(1)))
    return both.groupBy("key").agg(F.sum("n").alias("n"), F.max("known").alias("known"))


def unmatched_events(events: DataFrame, meta: DataFrame, key: str = "entity_id") -> DataFrame:
    """How many events have no metadata row; a null key matches nothing."""
    n = F.when((F.col("known") == 0) | F.col("key").isNull(), F.col("n"))
    return _keys_of_both(events, meta, key).agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("unmatched_events"))


def key_mismatch(events: DataFrame, meta: DataFrame, key: str = "entity_id") -> DataFrame:
    """Keys present on one side only, labelled ``events_only`` / ``metadata_only``."""
    side = (F.when(F.col("known") == 0, F.lit("events_only"))
            .when(F.col("n") == 0, F.lit("metadata_only")))
    return (_keys_of_both(events, meta, key).where(F.col("key").isNotNull())
            .select("key", side.alias("side")).where(F.col("side").isNotNull()))
