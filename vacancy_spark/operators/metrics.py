"""Key figures per vacancy and per dimension.

Shape of every metric: two hash aggregates.

* level 1 ``groupBy(*dims, entity)``: click and apply counts per vacancy (partial aggregate in
  each task, so a vacancy with a third of all events is reduced before the shuffle);
* level 2 ``groupBy(*dims)``: vacancy count, sums, exact medians. ``median``/``percentile``
  buffers hold one counter per *distinct* per-vacancy count, so they stay small however many
  vacancies a group has.

Null handling follows the reference (SURVEY S1, S2):

* a null entity is not a vacancy, but its events count in the totals and it adds one 0 to the
  median's input;
* a null dimension value yields a row of zeros (``null_group='zero'``), or is kept as a
  normal group (``'keep'``) or dropped (``'drop'``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import APPLY, CLICK

ENTITY = "entity_id"
EVENTS = "events_counted"  # in a frame of counted events: how many a row stands for


def _dims(dims) -> list[str]:
    if dims is None:
        return []
    return [dims] if isinstance(dims, str) else list(dims)


def _any_null(dims) -> Column:
    return reduce(lambda a, b: a | b, [F.col(d).isNull() for d in dims])


def ratio_pct(applies, clicks) -> Column:
    """applies / clicks * 100, 0 when there are no clicks (operation order kept)."""
    a, c = F.col(applies) if isinstance(applies, str) else applies, F.col(clicks) if isinstance(clicks, str) else clicks
    return F.when(c > 0, a / c * 100).otherwise(F.lit(0.0))


def events_where(df: DataFrame, condition: Column) -> Column:
    """Aggregate: number of events for which ``condition`` holds. A row is one event, or as many as
    the column EVENTS says (``plans.daily``)."""
    if EVENTS not in df.columns:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(EVENTS))), F.lit(0)).cast("bigint")


def events_in(df: DataFrame) -> Column:
    """Aggregate: number of events."""
    return events_where(df, F.lit(True)) if EVENTS in df.columns else F.count(F.lit(1))


def vacancy_counts(df: DataFrame, *dims, entity: str = ENTITY) -> DataFrame:
    """Clicks and applies per vacancy (every vacancy present in ``df``, zero-filled)."""
    return (df.groupBy(*dims, entity)
              .agg(events_where(df, F.col("event_name") == CLICK).alias("clicks"),
                   events_where(df, F.col("event_name") == APPLY).alias("applies")))


def _level2_aggs(entity: str = ENTITY) -> list[Column]:
    ent = F.col(entity)
    clicks_in = F.when(ent.isNull(), F.lit(0)).otherwise(F.col("clicks"))
    applies_in = F.when(ent.isNull(), F.lit(0)).otherwise(F.col("applies"))
    return [
        F.count(ent).alias("num_vacancies"),
        F.coalesce(F.sum("clicks"), F.lit(0)).cast("bigint").alias("total_clicks"),
        F.coalesce(F.sum("applies"), F.lit(0)).cast("bigint").alias("total_applies"),
        F.median(clicks_in).alias("_med_c"),
        F.median(applies_in).alias("_med_a"),
    ]


def _finish(agg: DataFrame, keep: list[str]) -> DataFrame:
    v = F.col("num_vacancies")
    has = v > 0
    return agg.select(
        *keep,
        "num_vacancies", "total_clicks", "total_applies",
        ratio_pct("total_applies", "total_clicks").alias("apply_click_ratio"),
        F.when(has, F.col("total_clicks") / v).otherwise(F.lit(0.0)).alias("mean_clicks_per_vacancy"),
        F.when(has, F.col("total_applies") / v).otherwise(F.lit(0.0)).alias("mean_applies_per_vacancy"),
        F.when(has, F.coalesce(F.col("_med_c"), F.lit(0.0))).otherwise(F.lit(0.0))
         .alias("median_clicks_per_vacancy"),
        F.when(has, F.coalesce(F.col("_med_a"), F.lit(0.0))).otherwise(F.lit(0.0))
         .alias("median_applies_per_vacancy"),
    )


def grouped_metrics(df: DataFrame, dims=None, entity: str = ENTITY,
                    null_group: str = "zero") -> DataFrame:
    """The full metric set per group of ``dims`` (one row in total when ``dims`` is empty)."""
    dims = _dims(dims)
    if null_group == "drop" and dims:
        df = df.where(~_any_null(dims))
    per_vac = vacancy_counts(df, *dims, entity=entity)
    agg = per_vac.groupBy(*dims).agg(*_level2_aggs(entity))
    out = _finish(agg, dims)
    if null_group == "zero" and dims:
        is_null = _any_null(dims)
        zero_cols = {
            "num_vacancies": F.lit(0).cast("bigint"), "total_clicks": F.lit(0).cast("bigint"),
            "total_applies": F.lit(0).cast("bigint"), "apply_click_ratio": F.lit(0.0),
            "mean_clicks_per_vacancy": F.lit(0.0), "mean_applies_per_vacancy": F.lit(0.0),
            "median_clicks_per_vacancy": F.lit(0.0), "median_applies_per_vacancy": F.lit(0.0),
        }
        out = out.withColumns({k: F.when(is_null, v).otherwise(F.col(k)) for k, v in zero_cols.items()})
    return out


def kpi_metrics(df: DataFrame, entity: str = ENTITY) -> DataFrame:
    """One row, ten fields: vacancies, clicks, applies, ratio, mean & median per vacancy,
    and the "per vacancy" aliases the comparison view shows."""
    m = grouped_metrics(df, None, entity)
    return m.select(
        "num_vacancies", "total_clicks", "total_applies", "apply_click_ratio",
        "mean_clicks_per_vacancy", "mean_applies_per_vacancy",
        "median_clicks_per_vacancy", "median_applies_per_vacancy",
        F.col("mean_clicks_per_vacancy").alias("clicks_per_vacancy"),
        F.col("mean_applies_per_vacancy").alias("applies_per_vacancy"),
    )


def basic_totals(df: DataFrame, entity: str = ENTITY) -> DataFrame:
    """Vacancies (distinct, non-null), clicks, applies."""
    return df.agg(F.count_distinct(entity).alias("num_vacancies"),
                  events_where(df, F.col("event_name") == CLICK).alias("total_clicks"),
                  events_where(df, F.col("event_name") == APPLY).alias("total_applies"))


def benchmark(df: DataFrame, dimension: str, entity: str = ENTITY,
              null_group: str = "zero") -> DataFrame:
    """Benchmark table for one dimension, rounded half-even, highest mean clicks first."""
    m = grouped_metrics(df, dimension, entity, null_group)
    return (m.select(
        dimension,
        F.col("num_vacancies").alias("vacancies"),
        "total_clicks", "total_applies",
        F.bround("apply_click_ratio", 2).alias("apply_click_pct"),
        F.bround("median_clicks_per_vacancy", 1).alias("median_clicks_per_vac"),
        F.bround("mean_clicks_per_vacancy", 1).alias("mean_clicks_per_vac"),
        F.bround("median_applies_per_vacancy", 2).alias("median_applies_per_vac"),
        F.bround("mean_applies_per_vacancy", 2).alias("mean_applies_per_vac"))
        .orderBy(F.desc_nulls_last("mean_clicks_per_vac"), F.asc_nulls_first(dimension)))


def overview_by(df: DataFrame, dimension: str, entity: str = ENTITY,
                null_group: str = "zero") -> DataFrame:
    """The seven-column overview table per importer / region."""
    m = grouped_metrics(df, dimension, entity, null_group)
    return (m.select(
        dimension,
        F.col("num_vacancies").alias("vacancies"),
        F.bround("median_clicks_per_vacancy", 1).alias("median_clicks"),
        F.bround("mean_clicks_per_vacancy", 1).alias("mean_clicks"),
        F.bround("median_applies_per_vacancy", 2).alias("median_applies"),
        F.bround("mean_applies_per_vacancy", 2).alias("mean_applies"),
        F.bround("apply_click_ratio", 2).alias("apply_click_pct"))
        .orderBy(F.desc_nulls_last("mean_clicks"), F.asc_nulls_first(dimension)))


def per_vacancy(df: DataFrame, entity: str = ENTITY) -> DataFrame:
    """Per-vacancy counts with the reference's treatment of a null entity (0 and 0)."""
    ent = F.col(entity)
    return (vacancy_counts(df, entity=entity)
            .select(entity,
                    F.when(ent.isNull(), F.lit(0)).otherwise(F.col("clicks")).cast("bigint").alias("clicks"),
                    F.when(ent.isNull(), F.lit(0)).otherwise(F.col("applies")).cast("bigint").alias("applies")))


def quartile_metrics(df: DataFrame, entity: str = ENTITY) -> DataFrame:
    """Top 25 % / middle 50 % / bottom 25 % of vacancies by clicks, six figures each.

    Thresholds are the linear-interpolated 25th/75th percentiles of clicks per vacancy
    (scalar subqueries: computed once, then used as literals). Groups are assigned with
    ``>=``/``<`` on those thresholds, so ties make the groups uneven. Fewer than four
    vacancies -> no rows. One global aggregate computes all three groups; ``stack`` turns
    it into three rows.
    """
    v = per_vacancy(df, entity)
    # The subquery reads both count columns (its applies total is unused), so its
    # per-vacancy aggregate is the same plan as the main query's and Spark reuses that
    # exchange instead of scanning and shuffling the events a second time.
    th = v.select(F.struct(F.percentile("clicks", F.array(F.lit(0.25), F.lit(0.75))).alias("q"),
                           F.sum("applies").alias("_a"))).scalar()
    q1, q3 = th["q"].getItem(0), th["q"].getItem(1)
    c = F.col("clicks")
    # the label is computed in a projection first: aggregate arguments may not contain a
    # subquery Spark treats as non-deterministic (e.g. over a CSV-read mapping)
    labelled = v.select(F.when(c >= q3, F.lit("top_25")).when(c >= q1, F.lit("middle_50"))
                         .otherwise(F.lit("bottom_25")).alias("_g"), "clicks", "applies")
    groups = ("top_25", "middle_50", "bottom_25")
    aggs = [F.count(F.lit(1)).alias("n")]
    for name in groups:
        cond = F.col("_g") == name
        aggs += [F.count_if(cond).alias(f"{name}_n"),
                 F.coalesce(F.sum(F.when(cond, c)), F.lit(0)).cast("bigint").alias(f"{name}_c"),
                 F.coalesce(F.sum(F.when(cond, F.col("applies"))), F.lit(0)).cast("bigint").alias(f"{name}_a")]
    one = labelled.agg(*aggs)
    stack = "stack(3, " + ", ".join(f"'{g}', {g}_n, {g}_c, {g}_a" for g in groups) + \
            ") AS (quartile, num_vacancies, total_clicks, total_applies)"
    rows = one.where(F.col("n") >= 4).selectExpr(stack)
    n, tc, ta = F.col("num_vacancies"), F.col("total_clicks"), F.col("total_applies")
    return rows.select(
        "quartile", "num_vacancies", "total_clicks", "total_applies",
        ratio_pct(ta, tc).alias("apply_click_ratio"),
        F.when(n > 0, tc / n).otherwise(F.lit(0.0)).alias("clicks_per_vacancy"),
        F.when(n > 0, ta / n).otherwise(F.lit(0.0)).alias("applies_per_vacancy"),
    )


def remove_outliers_iqr(df: DataFrame, value: str, by=None) -> DataFrame:
    """Keep rows whose ``value`` lies in [q1 - 1.5 iqr, q3 + 1.5 iqr] of its group; groups with
    fewer than four rows are kept whole. Null values never pass an active bound.

    Per-group bounds are one aggregate (one row per group) joined back on the group key; the
    global form uses scalar subqueries.
    """
    by = _dims(by)
    x = F.col(value)
    if not by:
        # every column is referenced so the subquery's input plan equals the main one and
        # Spark reuses its exchanges rather than recomputing ``df``
        stats = df.select(F.struct(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("q"),
                                   F.count(x).alias("n"),
                                   F.max(F.xxhash64(*[F.col(c) for c in df.columns])).alias("_all"))
                          ).scalar()
        q1, q3, n = stats["q"].getItem(0), stats["q"].getItem(1), stats["n"]
        iqr = q3 - q1
        return df.where((n < 4) | x.between(q1 - 1.5 * iqr, q3 + 1.5 * iqr))
    stats = df.groupBy(*by).agg(F.percentile(x, 0.25).alias("_q1"), F.percentile(x, 0.75).alias("_q3"),
                                F.count(x).alias("_n"))
    j = df.join(stats, by, "left")
    iqr = F.col("_q3") - F.col("_q1")
    keep = (F.col("_n") < 4) | x.between(F.col("_q1") - 1.5 * iqr, F.col("_q3") + 1.5 * iqr)
    return j.where(keep).drop("_q1", "_q3", "_n")


def iqr_mean(df: DataFrame, entity: str = ENTITY) -> DataFrame:
    """Mean clicks and applies per vacancy after removing click outliers (IQR rule)."""
    v = per_vacancy(df, entity)
    kept = remove_outliers_iqr(v, "clicks")
    return kept.agg(F.count(F.lit(1)).alias("vacancies_kept"),
                    F.avg("clicks").alias("iqr_mean_clicks"),
                    F.avg("applies").alias("iqr_mean_applies"))


def card_metrics(df: DataFrame, org: str = "organization_name", occupation: str = "occupation",
                 region: str = "regions") -> DataFrame:
    """Row count and distinct organisations / occupations / regions (absent column -> 0)."""
    have = [c for c in (org, occupation, region) if c in df.columns]
    # each combination once, so that the distinct counts expand few rows
    rows = df.groupBy(*have).agg(events_in(df).alias("_n")) if have else df.agg(events_in(df).alias("_n"))

    def nd(c):
        return F.count_distinct(c) if c in have else F.lit(0).cast("bigint")
    return rows.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total_records"),
                    nd(org).alias("unique_organizations"),
                    nd(occupation).alias("unique_occupations"),
                    nd(region).alias("unique_regions"))


def dataset_totals(df: DataFrame, entity: str = ENTITY) -> DataFrame:
    return df.agg(events_in(df).alias("total_events"),
                  F.count_distinct(entity).alias("unique_vacancies"))


def conversion_funnel(df: DataFrame, entity: str = ENTITY) -> DataFrame:
    """Three rows: Vacancies, Clicks, Applies."""
    return basic_totals(df, entity).selectExpr(
        "stack(3, 'Vacancies', num_vacancies, 'Clicks', total_clicks, 'Applies', total_applies) "
        "AS (stage, count)")


def verify_table(df: DataFrame, date_col: str = "event_date_parsed",
                 entity: str | None = "entity_id_str") -> DataFrame:
    """Rows, first and last date, distinct entities (the post-load check)."""
    aggs = [F.count(F.lit(1)).alias("total_rows"), F.min(date_col).alias("min_date"),
            F.max(date_col).alias("max_date")]
    if entity:
        aggs.append(F.count_distinct(entity).alias("unique_entities"))
    return df.agg(*aggs)


def performance_band(value, avg) -> Column:
    """'above' (> +10 %), 'below' (< -10 %), 'near' otherwise; null when either side is null
    or the average is 0."""
    v = F.col(value) if isinstance(value, str) else value
    a = F.col(avg) if isinstance(avg, str) else avg
    diff = (v - a) / a * 100
    return (F.when(v.isNull() | a.isNull() | (a == 0), F.lit(None).cast("string"))
             .when(diff > 10, F.lit("above"))
             .when(diff < -10, F.lit("below"))
             .otherwise(F.lit("near")))


def benchmark_bands(df: DataFrame, dimension: str, entity: str = ENTITY) -> DataFrame:
    """Each group's mean clicks and apply rate banded against the overall figures. A null
    group is the row of zeros of the benchmark tables (SURVEY S1).

    Groups and overall figures come from one per-(group, vacancy) count table, so the events
    are scanned and shuffled once; the overall figures are a scalar subquery over that
    (much smaller) table.
    """
    pv = vacancy_counts(df, dimension, entity=entity)
    vac = F.count_distinct(entity)
    tc = F.coalesce(F.sum("clicks"), F.lit(0))
    ta = F.coalesce(F.sum("applies"), F.lit(0))
    overall = pv.select(F.struct(
        F.when(vac > 0, tc / vac).otherwise(F.lit(0.0)).alias("mean_clicks"),
        ratio_pct(ta, tc).alias("ratio"))).scalar()
    g = _finish(pv.groupBy(dimension).agg(*_level2_aggs(entity)), [dimension])
    null = F.col(dimension).isNull()
    g = g.withColumns({c: F.when(null, F.lit(0.0)).otherwise(F.col(c))
                       for c in ("mean_clicks_per_vacancy", "apply_click_ratio")})
    return g.select(
        dimension, "mean_clicks_per_vacancy", "apply_click_ratio",
        performance_band("mean_clicks_per_vacancy", overall["mean_clicks"]).alias("clicks_band"),
        performance_band("apply_click_ratio", overall["ratio"]).alias("ratio_band"),
    )
