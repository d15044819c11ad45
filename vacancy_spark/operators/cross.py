"""Cross-dimension tables, value counts and mapping audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import id_string
from .metrics import events_in, grouped_metrics

MAX_PIVOT_LABELS = 1000  # columns a heatmap may have
# The three metrics a heatmap can show (columns of ``cross_metrics``).
HEATMAP_METRICS = ("clicks_per_vacancy", "applies_per_vacancy", "apply_click_ratio")


def cross_metrics(df: DataFrame, row: str = "uk_region", column: str = "importer_name") -> DataFrame:
    """Clicks/vacancy, applies/vacancy and apply/click % for every non-empty (row, column)
    cell; null labels never form a cell. One ``groupBy(row, column, entity)`` -> ``groupBy(row,
    column)`` instead of a scan per pair."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    m = grouped_metrics(cells, [row, column], null_group="keep")
    return m.select(row, column,
                    F.col("mean_clicks_per_vacancy").alias("clicks_per_vacancy"),
                    F.col("mean_applies_per_vacancy").alias("applies_per_vacancy"),
                    "apply_click_ratio")


def heatmap(df: DataFrame, metric: str = "clicks_per_vacancy", row: str = "uk_region",
            column: str = "importer_name", values=None) -> DataFrame:
    """One row per ``row`` label, one column per ``column`` label holding ``metric`` (null for
    an empty cell). Pass ``values`` for a fixed column set; otherwise the labels are those of
    the data, at most ``MAX_PIVOT_LABELS`` (more is an error, not a cut)."""
    if metric not in HEATMAP_METRICS:
        raise ValueError(f"heatmap metric must be one of {HEATMAP_METRICS}")
    cells = cross_metrics(df, row, column)
    if values is None:
        found = cells.select(column).distinct().limit(MAX_PIVOT_LABELS + 1).collect()
        if len(found) > MAX_PIVOT_LABELS:
            raise ValueError(f"{column} has more than {MAX_PIVOT_LABELS} labels; pass the values to show")
        values = sorted(r[0] for r in found)
    return cells.groupBy(row).pivot(column, list(values)).agg(F.first(metric))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent non-null values (ties broken by value)."""
    return (df.where(F.col(col).isNotNull())
              .groupBy(col).agg(events_in(df).alias("count"))
              .orderBy(F.desc("count"), F.asc(col))
              .limit(n))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per non-null value, most frequent first."""
    return (df.where(F.col(col).isNotNull())
              .groupBy(col).agg(events_in(df).alias("count"))
              .orderBy(F.desc("count"), F.asc(col)))


def mapping_audit(df: DataFrame, mapping: DataFrame, id_col: str = "importer_ID",
                  null_label: str = "<NA>") -> DataFrame:
    """Every distinct importer id in the data with its mapped name or ``'NOT FOUND'``."""
    ids = df.select(F.coalesce(id_string(id_col), F.lit(null_label)).alias("importer_id")).distinct()
    m = mapping.select(F.col("importer_id").alias("_id"), "importer_name")
    return (ids.join(m, ids.importer_id == m._id, "left")
               .select("importer_id", F.coalesce("importer_name", F.lit("NOT FOUND")).alias("mapped_name"))
               .orderBy("importer_id"))


def importer_record_counts(df: DataFrame, col: str = "importer_name") -> DataFrame:
    """Rows per importer name, sorted by name."""
    return df.groupBy(col).agg(events_in(df).alias("records")).orderBy(col)


def importer_names_in_use(df: DataFrame, mapping: DataFrame,
                          id_col: str = "importer_ID") -> DataFrame:
    """Mapping entries whose id occurs in the data (semi join: each entry once)."""
    ids = df.select(id_string(id_col).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    return mapping.join(ids, mapping.importer_id == ids._id, "left_semi")
