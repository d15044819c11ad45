"""Event-table scans.

Both scans are plain ``select``/``where`` over a Parquet (or catalog) table: Catalyst pushes
the date and event-name predicates into the scan (``PushedFilters``), prunes to the selected
columns (``ReadSchema``) and, for a table written by ``rebuild_typed_events``, prunes
``event_date_parsed`` partitions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import as_date_literal
from ..schema import ENRICHED_COLUMNS, REPORT_EVENTS
from .ranges import RangePartitions, has_ranges, read_ranges


def _as_frame(spark: SparkSession | None, df_or_path) -> DataFrame:
    if isinstance(df_or_path, DataFrame):
        return df_or_path
    if spark is None:
        spark = SparkSession.getActiveSession()
    if "/" in df_or_path or df_or_path.endswith(".parquet"):
        return spark.read.parquet(df_or_path)
    return spark.table(df_or_path)


def _ranges_of(spark: SparkSession | None, df_or_path) -> RangePartitions | None:
    """The descriptor beside the table's files; of a frame only if it is the table itself, as read."""
    if isinstance(df_or_path, DataFrame):
        plan = df_or_path._jdf.queryExecution().analyzed()
        while plan.getClass().getSimpleName() == "SubqueryAlias":
            plan = plan.child()
        if plan.getClass().getSimpleName() != "LogicalRelation" or \
                plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return None
        roots = plan.relation().location().rootPaths()
        return read_ranges(df_or_path.sparkSession, roots.head().toString()) if roots.size() == 1 else None
    spark = spark or SparkSession.getActiveSession()
    if "/" not in df_or_path and not df_or_path.endswith(".parquet"):
        place = [r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {df_or_path}").collect()
                 if r["col_name"] == "Location"]
        return read_ranges(spark, place[0]) if place else None
    return read_ranges(spark, df_or_path)


def _as_date(as_of) -> dt.date:
    if isinstance(as_of, str):
        return dt.date.fromisoformat(as_of[:10])
    return as_of.date() if isinstance(as_of, dt.datetime) else as_of


def scan_events(df_or_path, as_of, days_back: int = 30, sample_size: int | None = None,
                spark: SparkSession | None = None, repeatable: bool = False) -> DataFrame:
    """The 12-column report scan: events of the last ``days_back`` days, clicks and applies only.

    ``sample_size`` keeps n rows without an order, as the reference's LIMIT does; with
    ``repeatable=True`` it keeps the n rows with the smallest row hash instead (the same rows on
    every run; planned as a per-task top-n, not a full sort).
    """
    df = _as_frame(spark, df_or_path)
    cutoff = _as_date(as_of) - dt.timedelta(days=days_back)
    out = (df.select(*ENRICHED_COLUMNS)
             .where((F.col("event_date_parsed") >= as_date_literal(cutoff))
                    & F.col("event_name").isin(*REPORT_EVENTS)))
    if sample_size:
        if repeatable:
            out = out.orderBy(F.xxhash64(*[F.col(c) for c in ENRICHED_COLUMNS]))
        out = out.limit(int(sample_size))
    return out


def scan_events_legacy(df_or_path, as_of, days_back: int = 90,
                       spark: SparkSession | None = None, order: bool = True,
                       day_col: str | None = None, ranges: RangePartitions | None = None) -> DataFrame:
    """All columns with ``event_date`` (``YYYYMMDD`` string or integer) on or after the cut-off,
    newest first (``order=False`` skips the global sort when only aggregates follow).

    Partitions are pruned where the table has them: by ``day_col``, the parsed day that a typed
    table is partitioned by (dropped from the result), and by the ranges of a range-partitioned one:
    those of the descriptor beside the table, or ``ranges`` for a frame made from it. Without
    a descriptor for ``event_date`` no range is left out; rows in the buckets for other or
    unreadable dates always stay in the scan.
    """
    df = _as_frame(spark, df_or_path)
    ranges = ranges or _ranges_of(spark, df_or_path)
    first = _as_date(as_of) - dt.timedelta(days=days_back)
    cutoff = first.strftime("%Y%m%d")
    d = F.col("event_date")
    if isinstance(df.schema["event_date"].dataType, T.IntegralType):
        out, key = df.where(d >= F.lit(int(cutoff))), d
    else:
        out, key = df.where(d.cast("string") >= F.lit(cutoff)), d.cast("string")
    if has_ranges(df, ranges) and ranges.column == "event_date":
        out = out.where(ranges.from_on(int(cutoff), text=key is not d))
    if day_col:
        out = out.where((F.col(day_col) >= as_date_literal(first)) | F.col(day_col).isNull()).drop(day_col)
    if not order:
        return out
    # ties on the day are broken by vacancy and a row hash (the reference leaves them unordered)
    # so that one very large day is split over many sort tasks
    ties = ([F.col("entity_id").asc_nulls_first()] if "entity_id" in out.columns else []) + \
        [F.xxhash64(*[F.col(c) for c in out.columns])]
    return out.orderBy(key.desc(), *ties)


def require_table(spark: SparkSession, name: str) -> None:
    """Fail early, with the table name, when the source table is missing."""
    if not spark.catalog.tableExists(name):
        raise LookupError(f"table not found: {name}")


def preview(df: DataFrame, n: int = 10, order_by=None) -> DataFrame:
    """First ``n`` rows, ordered so the preview is repeatable (top-n, no full sort)."""
    keys = order_by or df.columns
    if isinstance(keys, str):
        keys = [keys]
    return df.orderBy(*keys).limit(n)
