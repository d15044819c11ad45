"""A/B comparison of two filter selections over one table.

Both sides come out of ONE scan and ONE shuffle: the side predicates become conditional
counts in a ``groupBy(entity)``; a global aggregate then gives each side's totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import APPLY, CLICK
from .filters import FilterSpec, spec_predicate
from .metrics import events_where

ENTITY = "entity_id"

# Compared metrics in display order; the ratio has no % change.
METRICS = ["vacancies", "clicks", "applies", "apply_click_ratio", "clicks_per_vacancy",
           "applies_per_vacancy"]


def side_totals(df: DataFrame, spec_a: FilterSpec | None, spec_b: FilterSpec | None,
                entity: str = ENTITY) -> DataFrame:
    """One row: vacancies, clicks, applies for side ``a`` and side ``b``."""
    pa = spec_predicate(spec_a, df.columns)
    pb = spec_predicate(spec_b, df.columns)
    pa = F.lit(True) if pa is None else F.coalesce(pa, F.lit(False))
    pb = F.lit(True) if pb is None else F.coalesce(pb, F.lit(False))
    click, apply_ = F.col("event_name") == CLICK, F.col("event_name") == APPLY
    per = (df.groupBy(entity)
             .agg(F.count_if(pa).alias("rows_a"), events_where(df, pa & click).alias("clicks_a"),
                  events_where(df, pa & apply_).alias("applies_a"),
                  F.count_if(pb).alias("rows_b"), events_where(df, pb & click).alias("clicks_b"),
                  events_where(df, pb & apply_).alias("applies_b")))
    ent = F.col(entity)
    return per.agg(
        F.count_if(ent.isNotNull() & (F.col("rows_a") > 0)).alias("vacancies_a"),
        F.coalesce(F.sum("clicks_a"), F.lit(0)).cast("bigint").alias("clicks_a"),
        F.coalesce(F.sum("applies_a"), F.lit(0)).cast("bigint").alias("applies_a"),
        F.count_if(ent.isNotNull() & (F.col("rows_b") > 0)).alias("vacancies_b"),
        F.coalesce(F.sum("clicks_b"), F.lit(0)).cast("bigint").alias("clicks_b"),
        F.coalesce(F.sum("applies_b"), F.lit(0)).cast("bigint").alias("applies_b"),
    )


def _side_metrics(t: DataFrame) -> DataFrame:
    out = t
    for s in ("a", "b"):
        v, c, a = F.col(f"vacancies_{s}"), F.col(f"clicks_{s}"), F.col(f"applies_{s}")
        out = out.withColumns({
            f"apply_click_ratio_{s}": F.when(c > 0, a / c * 100).otherwise(F.lit(0.0)),
            f"clicks_per_vacancy_{s}": F.when(v > 0, c / v).otherwise(F.lit(0.0)),
            f"applies_per_vacancy_{s}": F.when(v > 0, a / v).otherwise(F.lit(0.0)),
        })
    return out


def compare(df: DataFrame, spec_a: FilterSpec | None, spec_b: FilterSpec | None,
            entity: str = ENTITY) -> DataFrame:
    """Six rows (metric, side_a, side_b, diff, pct_change, direction).

    ``diff = b - a``; ``pct_change = (b / a - 1) * 100``, 0 when a <= 0, null for the ratio
    metric; direction is ``up`` / ``down`` / ``equal`` by the sign of ``diff``.
    """
    w = _side_metrics(side_totals(df, spec_a, spec_b, entity))
    stack = "stack(6, " + ", ".join(
        f"'{m}', CAST({m}_a AS DOUBLE), CAST({m}_b AS DOUBLE)" for m in METRICS
    ) + ") AS (metric, side_a, side_b)"
    rows = w.selectExpr(stack)
    a, b = F.col("side_a"), F.col("side_b")
    diff = b - a
    return rows.select(
        "metric", "side_a", "side_b", diff.alias("diff"),
        F.when(F.col("metric") == "apply_click_ratio", F.lit(None).cast("double"))
         .when(a > 0, (b / a - 1) * 100).otherwise(F.lit(0.0)).alias("pct_change"),
        F.when(diff > 0, F.lit("up")).when(diff < 0, F.lit("down")).otherwise(F.lit("equal"))
         .alias("direction"),
    )


def compare_long(df: DataFrame, spec_a: FilterSpec | None, spec_b: FilterSpec | None,
                 entity: str = ENTITY) -> DataFrame:
    """Six rows (side, metric, value): vacancies, clicks and applies of each side."""
    t = side_totals(df, spec_a, spec_b, entity)
    return t.selectExpr(
        "stack(6, 'A', 'Vacancies', vacancies_a, 'B', 'Vacancies', vacancies_b, "
        "'A', 'Clicks', clicks_a, 'B', 'Clicks', clicks_b, "
        "'A', 'Applies', applies_a, 'B', 'Applies', applies_b) AS (side, metric, value)")
