"""Projection, cleaning, typing and dedup.

Every function is DataFrame -> DataFrame built from column expressions; lookups are joins
whose strategy (broadcast vs shuffle) Spark picks from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_dmy_hm, parse_iso_timestamp, parse_yyyymmdd, to_naive_timestamp, as_ts_literal
from ..functions.text import first_token, id_string, is_blank, split_pipe, trim_ws
from ..schema import REPORT_RENAMES

# Fixed value: how a null importer id prints after ``astype(str)`` on a nullable integer column.
NULL_ID_LABEL = "<NA>"


def prepare_enriched(df: DataFrame) -> DataFrame:
    """Rename the enriched table's columns to the report's names (missing ones are skipped)."""
    renames = {k: v for k, v in REPORT_RENAMES.items() if k in df.columns}
    return df.withColumnsRenamed(renames)


def clean_importer_mapping(mapping: DataFrame, strip: bool = True) -> DataFrame:
    """Drop null/blank ids, strip both fields, keep the last row per id (file order)."""
    m = mapping.select(
        F.col("importer_id").cast("string").alias("importer_id"),
        F.col("importer_name").cast("string").alias("importer_name"),
        F.monotonically_increasing_id().alias("_pos"),
    ).where(~is_blank("importer_id"))
    key = id_string("importer_id") if strip else F.col("importer_id")
    name = trim_ws("importer_name") if strip else F.col("importer_name")
    return (m.select(key.alias("importer_id"), name.alias("importer_name"), "_pos")
             .groupBy("importer_id")
             .agg(F.max_by("importer_name", "_pos").alias("importer_name")))


def apply_importer_mapping(df: DataFrame, mapping: DataFrame | None, id_col: str = "importer_ID",
                           fallback: str = "prefixed", null_label: str = NULL_ID_LABEL,
                           strip_ids: bool = True) -> DataFrame:
    """Importer id -> name. Unmapped ids show as ``'ID: <id>'`` (``fallback='prefixed'``) or the
    raw id (``'raw'``); without a mapping every row gets the fallback; without the id column
    every row is ``'Unknown'``. ``strip_ids=False`` matches the ids as stored (the all-string
    sheet flow does not strip them).

    ``mapping`` must already be clean (``clean_importer_mapping``): one row per id.
    """
    if id_col not in df.columns:
        return df.withColumn("importer_name", F.lit("Unknown"))
    raw_id = id_string(id_col) if strip_ids else F.col(id_col).cast("string")
    sid = F.coalesce(raw_id, F.lit(null_label))
    out = df.withColumn("importer_id_str", sid)
    fb = (F.concat(F.lit("ID: "), F.col("importer_id_str")) if fallback == "prefixed"
          else F.col("importer_id_str"))
    if mapping is None:
        return out.withColumn("importer_name", fb)
    m = mapping.select(F.col("importer_id").alias("_map_id"), F.col("importer_name").alias("_map_name"))
    return (out.join(m, out.importer_id_str == m._map_id, "left")
               .withColumn("importer_name", F.coalesce(F.col("_map_name"), fb))
               .drop("_map_id", "_map_name"))


def parse_upgrades(df: DataFrame, col: str = "upgrades") -> DataFrame:
    """``upgrades_list``: pipe tokens, stripped, empty tokens kept; null/blank -> ``[]``."""
    if col not in df.columns:
        return df
    empty = F.array().cast(T.ArrayType(T.StringType()))
    return df.withColumn("upgrades_list", F.when(is_blank(col), empty).otherwise(split_pipe(col)))


def upgrade_vocabulary(df: DataFrame, col: str = "upgrades_list") -> DataFrame:
    """Sorted distinct upgrade tokens (pre-aggregated per partition before the shuffle)."""
    return (df.select(F.explode(col).alias("upgrade"))
              .distinct()
              .orderBy("upgrade"))


def add_occupation(df: DataFrame, col: str = "occupational_fields") -> DataFrame:
    """``occupation``: first pipe token, stripped; null/blank -> ``'Unknown'``."""
    if col not in df.columns:
        return df.withColumn("occupation", F.lit("Unknown"))
    return df.withColumn("occupation",
                         F.when(is_blank(col), F.lit("Unknown")).otherwise(first_token(col)))


def parse_dates(df: DataFrame, cols=("event_date", "start_date", "end_date")) -> DataFrame:
    """Coerce date columns to naive UTC timestamps (bad values -> null).

    ``event_date`` stays a DATE when it already is one: every later use takes its day, and
    keeping the type lets date predicates reach the partition column.
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    out = df
    for c in cols:
        if c not in types:
            continue
        if c == "event_date" and isinstance(types[c], T.DateType):
            continue
        out = out.withColumn(c, to_naive_timestamp(c, types[c]))
    return out


def parse_yyyymmdd_column(df: DataFrame, col: str = "event_date", out: str | None = None,
                          strict: bool = False) -> DataFrame:
    return df.withColumn(out or col, parse_yyyymmdd(col, strict=strict))


def normalise_metadata(df: DataFrame, as_of, null_fill: str | None = "", dates: str = "dmy") -> DataFrame:
    """Job export -> metadata table shape: strings (nulls -> ``null_fill``), dates parsed,
    optional columns added empty, ``last_updated`` stamped with ``as_of``.

    ``dates``: ``dmy`` reads day-first text leniently (the file load), ``iso`` reads ISO text
    strictly (the SQL load). A ``_position`` column is carried along.
    """
    def s(name, src=None):
        src = src or name
        c = F.col(src).cast("string") if src in df.columns else F.lit(None).cast("string")
        if null_fill is not None:
            c = F.coalesce(c, F.lit(null_fill))
        return c.alias(name)

    date = {"dmy": parse_dmy_hm, "iso": parse_iso_timestamp}[dates]
    return df.select(
        s("entity_id", "job_id" if "job_id" in df.columns else "entity_id"),
        s("title"), s("workflow_state"), s("occupational_fields"), s("locations"),
        date("publishing_date").alias("publishing_date"),
        date("expiration_date").alias("expiration_date"),
        s("organization_profile_name"), s("organization_id"), s("employment_type"),
        as_ts_literal(as_of).alias("last_updated"),
        *[c for c in ("_position",) if c in df.columns],
    )


def dedup_latest(df: DataFrame, key, order) -> DataFrame:
    """Keep one row per ``key``: the greatest by ``order`` (a column or list of columns).

    ``max_by`` over a struct: a sort-based aggregate with a partial step, so a hot key is
    reduced inside each task before the shuffle. Of many equal rows, reduce them first.
    """
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, (str, F.Column)) else list(order)
    orders = [F.col(o) if isinstance(o, str) else o for o in orders]
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    ordkey = F.struct(*orders)
    return (df.groupBy(*keys)
              .agg(F.max_by(row, ordkey).alias("_row"))
              .select(*keys, "_row.*"))


def first_row_per(df: DataFrame, key: str = "entity_id", order=None) -> DataFrame:
    """One representative row per vacancy: newest event day first, then the attribute columns
    (a fixed choice where the reference relied on load order).

    Equal rows are reduced by a hash aggregate first, so the events are never sorted.
    """
    rows = latest_of_equal(df, "event_date")
    if order is None:
        date_col = "event_date" if "event_date" in df.columns else None
        attrs = [c for c in df.columns if c not in (key, date_col)
                 and not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType))]
        order = ([F.col(date_col)] if date_col else []) + [F.col(c) for c in attrs]
    return dedup_latest(rows, key, order).select(df.columns)


def latest_of_equal(df: DataFrame, date_col: str, *aggregates, drop=()) -> DataFrame:
    """One row for each distinct combination of the other columns, with the latest ``date_col``
    (which is grouped by too if it isn't of fixed width) and the given aggregates.

    The buffers are of fixed width, so Spark plans a hash aggregate with a partial step.
    """
    has_date = date_col in df.columns
    fixed = has_date and not isinstance(df.schema[date_col].dataType, (T.StringType, T.BinaryType))
    keys = [c for c in df.columns if c not in drop and not (fixed and c == date_col)]
    latest = [F.max(date_col).alias(date_col)] if fixed else []
    return df.groupBy(*keys).agg(*latest, *aggregates) if latest or aggregates else df.select(*keys).distinct()


def select_columns(df: DataFrame, cols=None,
                   default=("event_date", "event_name", "organization_name", "occupation",
                            "regions", "importer_name")) -> DataFrame:
    """The chosen columns that exist; none chosen -> the default six that exist; none -> all."""
    chosen = [c for c in (cols if cols else default) if c in df.columns]
    return df.select(*chosen) if chosen else df

