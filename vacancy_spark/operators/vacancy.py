"""Vacancy-level reports.

The reference loops over vacancies and rescans the event frame twice per vacancy. Here a
vacancy table is ONE aggregate keyed by the vacancy: the representative row (``max_by`` over
a struct) and the click/apply counts come out of the same shuffle, with partial aggregation
before it. Events that differ only in their day and name are counted by a hash aggregate
first, so what the representative row is chosen from (strings, hence a sort-based aggregate)
is about one row per vacancy. The occupation benchmark is a second, much smaller aggregate
joined on the occupation label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import as_ts_literal, whole_days_between
from ..functions.regions import region_from_address
from ..schema import APPLY, CLICK
from ..session import fresh_path
from .clean import latest_of_equal
from .filters import filter_vacancies
from .joins import export_rows
from .metrics import EVENTS, events_where
from .regions import add_region_column

ENTITY = "entity_id"


def _orders(df: DataFrame, attrs, date_col: str) -> list[str]:
    """Columns that decide which row represents a vacancy: the day, then the others that sort."""
    sortable = [c for c in attrs
                if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
    return sorted(sortable, key=lambda c: c != date_col)


def vacancy_table(df: DataFrame, entity: str = ENTITY, date_col: str = "event_date") -> DataFrame:
    """One row per vacancy: its representative attributes, clicks and applies.

    Two steps. First the events are counted for each distinct combination of vacancy and
    attributes, with the latest day: fixed-width buffers, hence a hash aggregate whose partial
    step reduces each task's events. Then the newest of a vacancy's few combinations is taken
    (ties by the other columns: a fixed rule where the reference took whichever row loaded
    first). A null vacancy id counts 0 clicks and 0 applies, as in the reference's per-vacancy
    lookups.
    """
    attrs = [c for c in df.columns if c not in (entity, "event_name", EVENTS)]
    rows = latest_of_equal(df, date_col, events_where(df, F.col("event_name") == CLICK).alias("_clicks"),
                           events_where(df, F.col("event_name") == APPLY).alias("_applies"),
                           drop=("event_name", EVENTS))
    g = rows.groupBy(entity).agg(
        F.max_by(F.struct(*attrs), F.struct(*_orders(df, attrs, date_col))).alias("_row")
        if attrs else F.first(F.struct(F.lit(1).alias("_none"))).alias("_row"),
        F.sum("_clicks").alias("clicks"), F.sum("_applies").alias("applies"))

    def counted(c):
        return F.when(F.col(entity).isNull(), F.lit(0)).otherwise(F.col(c)).cast("bigint").alias(c)
    return g.select(entity, *[F.col(f"_row.{c}").alias(c) for c in attrs],
                    counted("clicks"), counted("applies"))


def days_active_raw(start, end, status, as_of) -> Column:
    """Whole 24-hour days end - start; with no end, a published vacancy counts to ``as_of``."""
    s, e = F.col(start), F.col(end)
    return (F.when(s.isNotNull() & e.isNotNull(), whole_days_between(s, e))
             .when(s.isNotNull() & (F.col(status) == "published"),
                   whole_days_between(s, as_ts_literal(as_of))))


def occupation_benchmark(full_df: DataFrame, entity: str = ENTITY,
                         vacancies: DataFrame | None = None) -> DataFrame:
    """Mean clicks and applies per vacancy by occupation over the UNFILTERED data, 1 dp.

    ``vacancies`` may pass an already computed vacancy table of ``full_df`` (saves a shuffle)."""
    v = vacancies if vacancies is not None else vacancy_table(
        full_df.select(*_present(full_df, entity, "event_date", "event_name", "occupation", EVENTS)), entity)
    return (v.groupBy("occupation")
             .agg(F.bround(F.avg("clicks"), 1).alias("avg_clicks_occupation"),
                  F.bround(F.avg("applies"), 1).alias("avg_applies_occupation")))


def _present(df: DataFrame, *columns: str) -> list[str]:
    return [c for c in columns if c in df.columns]


REPORT_COLUMNS = ("event_date", "event_name", "title", "organization_name", "workflow_state",
                  "start_date", "end_date", "uk_region", "occupation", "importer_name",
                  "upgrades_list")


def _report_rows(v: DataFrame, entity: str, as_of) -> DataFrame:
    raw = days_active_raw("start_date", "end_date", "workflow_state", as_of)
    clicks, applies = F.col("clicks"), F.col("applies")
    up = F.array_join(F.coalesce(F.col("upgrades_list"), F.array().cast("array<string>")), ", ")
    return v.select(
        F.col("title"), F.col("organization_name").alias("company"), F.col(entity).alias("job_id"),
        F.col("workflow_state").alias("status"), "start_date", "end_date",
        F.when(raw > 0, raw.cast("int")).alias("days_active"),
        F.col("uk_region").alias("region"), "occupation",
        F.col("importer_name").alias("importer"),
        F.when(up == "", F.lit("None")).otherwise(up).alias("upgrades"),
        clicks, applies,
        F.when(clicks > 0, F.bround(applies / clicks * 100, 2)).alias("ratio_pct"),
        F.when(raw > 0, F.bround(clicks / raw, 2)).alias("clicks_per_day"),
        F.when(raw > 0, F.bround(applies / raw, 2)).alias("applies_per_day"),
    )


def _with_benchmark(rep: DataFrame, bench: DataFrame) -> DataFrame:
    return (rep.join(bench, "occupation", "left")
               .withColumn("avg_clicks_occupation", F.coalesce("avg_clicks_occupation", F.lit(0.0)))
               .withColumn("avg_applies_occupation", F.coalesce("avg_applies_occupation", F.lit(0.0)))
               .orderBy(F.desc("clicks"), F.asc_nulls_first("job_id")))


def vacancy_report(df: DataFrame, as_of, full_df: DataFrame | None = None,
                   entity: str = ENTITY) -> DataFrame:
    """The 18-column vacancy report, most clicks first. Occupation benchmarks
    come from ``full_df`` (the unfiltered data); when it is ``df`` itself, the same vacancy
    table serves both, so the report costs one shuffle of the events. When the report is a
    filter of the full data, ``vacancy_report_filtered`` does both in one pass."""
    same = full_df is None or full_df is df
    full_df = df if full_df is None else full_df
    v = vacancy_table(df.select(*_present(df, entity, *REPORT_COLUMNS, EVENTS)), entity)
    bench = occupation_benchmark(full_df, entity, vacancies=v if same else None)
    return _with_benchmark(_report_rows(v, entity, as_of), bench)


def vacancy_report_filtered(full: DataFrame, spec, as_of, entity: str = ENTITY) -> DataFrame:
    """``vacancy_report(apply_filters(full, spec), as_of, full)`` with ONE scan and ONE shuffle
    of the events.

    The filter becomes a flag: each vacancy's aggregate keeps the representative row and the
    counts of its matching events (``max_by`` ignores rows whose ordering is null) next to its
    all-event counts and all-event occupation, in the two steps of ``vacancy_table``. That
    per-vacancy table is written as Parquet to the shared folder -- this runs a job when called,
    and the folder is the caller's to delete once the report is stored -- and both the report
    rows and the occupation benchmark are read from it, so the events are not scanned twice and
    a lost executor never forces the event aggregate to be recomputed.
    """
    from .filters import spec_predicate
    pred = spec_predicate(spec, full.columns)
    if pred is None:
        return vacancy_report(full, as_of, full, entity)
    keep = _present(full, entity, *REPORT_COLUMNS, EVENTS)
    df = full.withColumn("_in", F.coalesce(pred, F.lit(False))).select(*keep, "_in")
    attrs = [c for c in keep if c not in (entity, "event_name", EVENTS)]
    inside, click, apply_ = F.col("_in"), F.col("event_name") == CLICK, F.col("event_name") == APPLY
    ent, day = F.col(entity), F.col("event_date")
    rest = [c for c in attrs if c != "event_date"]
    rows = (df.groupBy(entity, *rest)
              .agg(F.max(day).alias("_day_all"), F.max(F.when(inside, day)).alias("event_date"),
                   F.count_if(inside).alias("_n"),
                   events_where(df, inside & click).alias("_c"), events_where(df, inside & apply_).alias("_a"),
                   events_where(df, click).alias("_c_all"), events_where(df, apply_).alias("_a_all")))
    others = [c for c in _orders(df, attrs, "event_date") if c != "event_date"]
    g = (rows.groupBy(entity)
             .agg(F.max_by(F.struct(*attrs),
                           F.when(F.col("_n") > 0, F.struct("event_date", *others))).alias("_row"),
                  F.max_by("occupation", F.struct("_day_all", *others)).alias("_occ_all"),
                  *[F.sum(c).alias(c) for c in ("_n", "_c", "_a", "_c_all", "_a_all")]))
    path = fresh_path(full.sparkSession, "vacancy_counts")
    g.write.parquet(path)
    g = full.sparkSession.read.parquet(path)
    zero = F.lit(0).cast("bigint")
    bench = (g.select(F.col("_occ_all").alias("occupation"),
                      F.when(ent.isNull(), zero).otherwise(F.col("_c_all")).alias("c"),
                      F.when(ent.isNull(), zero).otherwise(F.col("_a_all")).alias("a"))
              .groupBy("occupation")
              .agg(F.bround(F.avg("c"), 1).alias("avg_clicks_occupation"),
                   F.bround(F.avg("a"), 1).alias("avg_applies_occupation")))
    v = g.where(F.col("_n") > 0).select(
        entity, "_row.*",
        F.when(ent.isNull(), zero).otherwise(F.col("_c")).cast("bigint").alias("clicks"),
        F.when(ent.isNull(), zero).otherwise(F.col("_a")).cast("bigint").alias("applies"))
    return _with_benchmark(_report_rows(v, entity, as_of), bench)


def days_active(df: DataFrame, as_of, entity: str = ENTITY) -> DataFrame:
    """Per vacancy: start, end, status, whole days active (> 0, else null)."""
    v = vacancy_table(df.select(entity, "event_date", "event_name", "start_date", "end_date",
                                "workflow_state"), entity)
    raw = days_active_raw("start_date", "end_date", "workflow_state", as_of)
    return v.select(F.col(entity).alias("job_id"), "start_date", "end_date",
                    F.col("workflow_state").alias("status"),
                    F.when(raw > 0, raw.cast("int")).alias("days_active"))


def vacancy_totals(vac: DataFrame, clicks: str = "clicks", applies: str = "applies",
                   ratio: str = "ratio_pct") -> DataFrame:
    """Vacancies, clicks, applies and the mean of the per-vacancy ratio (nulls skipped)."""
    return vac.agg(F.count(F.lit(1)).alias("total_vacancies"),
                   F.coalesce(F.sum(clicks), F.lit(0)).cast("bigint").alias("total_clicks"),
                   F.coalesce(F.sum(applies), F.lit(0)).cast("bigint").alias("total_applies"),
                   F.avg(ratio).alias("avg_apply_rate"))


def _legacy_columns(v: DataFrame, entity: str, title: Column, org: Column, region: Column) -> DataFrame:
    clicks, applies = F.col("clicks"), F.col("applies")

    def date_or_na(c):
        return F.col(c) if c in v.columns else F.lit("N/A")

    return v.select(
        title.alias("title"), org.alias("organisation"), F.col(entity).alias("job_id"),
        date_or_na("start_date").alias("start_date"), date_or_na("end_date").alias("end_date"),
        region.alias("region"),
        clicks.alias("total_clicks"), applies.alias("total_apply_start"),
        F.when(clicks > 0, F.bround(applies / clicks * 100, 2)).otherwise(F.lit(0.0))
         .alias("apply_click_ratio_pct"),
    )


def vacancy_report_legacy(df: DataFrame, entity: str = ENTITY, export: DataFrame | None = None,
                          postcode_mode: str = "reference") -> DataFrame:
    """The previous report: nine columns; ratio 0 (not null) without clicks; dates ``'N/A'``
    when the frame has no date columns.

    With ``export``, ``df`` is the events alone and the report is that of the events merged with
    the job export, but aggregated before the join: the events per vacancy, the export's rows
    per vacancy (each address parsed once), then the two small tables. Every event meets every
    matching export row, so the counts are multiplied by the number of those; the newest merged
    row is the newest event's columns beside the greatest export row's.
    """
    merged = ("start_date", "end_date", "uk_region") if export is not None else ()
    keep = [c for c in (entity, "event_date", "event_name", "title", "organization_name",
                        "start_date", "end_date", "uk_region") if c in df.columns and c not in merged]
    v = vacancy_table(df.select(*keep), entity)
    if export is not None:
        v = _with_export(v, export, entity, postcode_mode)
    title = F.col("title") if "title" in v.columns else (
        F.col("organization_name") if "organization_name" in v.columns else F.lit("Unknown"))
    org = F.col("organization_name") if "organization_name" in v.columns else F.lit("Unknown")
    region = F.col("uk_region") if "uk_region" in v.columns else F.lit("Unknown")
    return (_legacy_columns(v, entity, title, org, region)
            .orderBy(F.desc("total_clicks"), F.asc_nulls_first("job_id")))


def _with_export(v: DataFrame, export: DataFrame, entity: str, postcode_mode: str) -> DataFrame:
    x = add_region_column(export_rows(export, v.columns, entity), postcode_mode=postcode_mode)
    cols = [c for c in ("title", "start_date", "end_date", "uk_region")
            if c in x.columns and c not in v.columns]
    x = (x.where(F.col(entity).isNotNull()).groupBy(entity)
          .agg(F.count(F.lit(1)).alias("_rows"), F.max_by(F.struct(*cols), F.struct(*cols)).alias("_x")))
    times = F.coalesce(F.col("_rows"), F.lit(1))
    out = v.join(x, entity, "left").select(
        *[c for c in v.columns if c not in ("clicks", "applies")],
        *[F.col(f"_x.{c}").alias(c) for c in cols],
        (F.col("clicks") * times).alias("clicks"), (F.col("applies") * times).alias("applies"))
    return out.withColumn("uk_region", F.coalesce("uk_region", F.lit("Unknown")))


def vacancy_view(df: DataFrame, regions=(), orgs=(), entity: str = ENTITY,
                 postcode_mode: str = "reference") -> DataFrame:
    """The stand-alone vacancy page: region parsed from each vacancy's address, title falling
    back to the organisation, organisation to ``entity_name``; then the page's filters."""
    keep = [c for c in (entity, "event_date", "event_name", "title", "organization_name",
                        "entity_name", "start_date", "end_date", "regions") if c in df.columns]
    v = vacancy_table(df.select(*keep), entity)
    title = F.col("title") if "title" in v.columns else F.col("organization_name")
    org = F.col("organization_name") if "organization_name" in v.columns else F.col("entity_name")
    region = region_from_address("regions", postcode_mode) if "regions" in v.columns else F.lit("Unknown")
    out = _legacy_columns(v, entity, title, org, region)
    return (filter_vacancies(out, regions, orgs, "region", "organisation")
            .orderBy(F.desc("total_clicks"), F.asc_nulls_first("job_id")))
