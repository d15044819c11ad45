"""The reference's report flows as lazy DataFrame bundles.

``load_report_frame`` is the current app's load -> enrich path over any table of the enriched
schema; ``overview`` / ``deep_dive`` / ``vacancy_performance`` / ``comparison`` return the
tables behind each of its four tabs. ``load_legacy_frame`` is the previous app's path (raw
events, importer mapping, parsed dates, regions, job export). Nothing runs until a returned
DataFrame is used; callers showing several tables of one bundle may ``cache()`` the frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean as C
from ..operators import compare as H
from ..operators import cross as X
from ..operators import metrics as M
from ..operators import trends as T
from ..operators import vacancy as V
from ..operators.filters import FilterSpec, apply_filters
from ..operators.joins import merge_job_export
from ..sources.events import scan_events, scan_events_legacy
from ..sources.files import read_importer_mapping, read_job_export
from .addresses import add_region_column
from .enrich import enrich


def load_report_frame(spark: SparkSession, source, as_of, days_back: int = 30,
                      mapping_path: str | None = None, sample_size: int | None = None) -> DataFrame:
    """Scan the enriched table (path or table name) for the window and enrich it."""
    scanned = scan_events(source, as_of, days_back, sample_size, spark=spark)
    mapping = read_importer_mapping(spark, mapping_path) if mapping_path else None
    return enrich(scanned, mapping)


def overview(df: DataFrame, spec: FilterSpec | None = None) -> dict[str, DataFrame]:
    f = apply_filters(df, spec)
    return {
        "kpis": M.kpi_metrics(f),
        "quartiles": M.quartile_metrics(f),
        "daily_trend": T.daily_trend(f),
        "by_importer": M.overview_by(f, "importer_name"),
        "by_region": M.overview_by(f, "uk_region"),
        "funnel": M.conversion_funnel(f),
    }


# The deep-dive dimensions and their columns.
DIMENSIONS = {"Importer": "importer_name", "Region": "uk_region", "Occupation": "occupation",
              "Company": "organization_name"}


def deep_dive(df: DataFrame, spec: FilterSpec | None = None, dimension: str = "Importer",
              heatmap_metric: str = "clicks_per_vacancy", heatmap_columns=None) -> dict[str, DataFrame]:
    """Benchmark table for one dimension, region x importer cells and their pivot. Without
    ``heatmap_columns`` the pivot's importer columns are discovered from the data."""
    f = apply_filters(df, spec)
    return {
        "benchmark": M.benchmark(f, DIMENSIONS.get(dimension, dimension)),
        "heatmap_cells": X.cross_metrics(f),
        "heatmap": X.heatmap(f, heatmap_metric, values=heatmap_columns),
    }


def vacancy_performance(df: DataFrame, as_of, spec: FilterSpec | None = None) -> dict[str, DataFrame]:
    """Vacancy report of the filtered rows with occupation benchmarks from all of ``df``."""
    report = V.vacancy_report_filtered(df, spec, as_of)
    return {"report": report, "totals": V.vacancy_totals(report)}


def comparison(df: DataFrame, spec_a: FilterSpec | None, spec_b: FilterSpec | None) -> dict[str, DataFrame]:
    return {"summary": H.compare(df, spec_a, spec_b), "long": H.compare_long(df, spec_a, spec_b)}


def load_legacy_frame(spark: SparkSession, source, as_of, days_back: int = 90,
                      mapping_path: str | None = None, export_path: str | None = None,
                      postcode_mode: str = "reference", addresses: str | None = None) -> DataFrame:
    """The previous app's frame: raw events of the window, importer names (unstripped mapping),
    ``event_date`` parsed, regions from the raw ``regions`` address -- derived before the job
    export is merged, as that app does (SURVEY 3.3) -- then the export's columns.

    Regions come from the stored address dictionary (``plans.addresses``; its path: ``addresses``), to
    which addresses that it lacks are added first: that runs a job, and no event is parsed."""
    raw = scan_events_legacy(source, as_of, days_back, spark=spark, order=False)
    mapping = read_importer_mapping(spark, mapping_path, strip=False) if mapping_path else None
    df = C.apply_importer_mapping(raw, mapping, id_col="importer_id")
    df = C.parse_yyyymmdd_column(df, "event_date")
    df = add_region_column(df, postcode_mode, addresses)
    if export_path:
        df = merge_job_export(df, read_job_export(spark, export_path))
    return df


def legacy_overview(df: DataFrame) -> dict[str, DataFrame]:
    """Cards, top occupations, region distribution and daily counts of the previous app."""
    out = {"cards": M.card_metrics(df, occupation="occupations", region="uk_region"),
           "daily_counts": T.daily_counts(df, "event_date"),
           "regions": X.value_counts(df, "uk_region")}
    if "occupation" in df.columns:
        out["top_occupations"] = X.top_values(df, "occupation", 10)
    return out


def load_sheet_frame(spark: SparkSession, path: str, mapping_path: str | None = None) -> DataFrame:
    """The first app's frame: an all-string table with a header row, importer names with the
    raw id as fallback, and the ``event_data`` column parsed from ``YYYYMMDD``."""
    from ..sources.files import read_all_string
    df = read_all_string(spark, path)
    mapping = read_importer_mapping(spark, mapping_path, strip=False) if mapping_path else None
    if "importer_id" in df.columns:
        df = C.apply_importer_mapping(df, mapping, id_col="importer_id", fallback="raw",
                                      strip_ids=False)
    if "event_data" in df.columns:
        df = C.parse_yyyymmdd_column(df, "event_data")
    return df


def sheet_overview(df: DataFrame) -> dict[str, DataFrame]:
    """Cards, top-10 occupations / regions / importers and daily counts of the first app."""
    out = {"cards": M.card_metrics(df)}
    for key, col in (("top_occupations", "occupation"), ("top_regions", "regions"),
                     ("top_importers", "importer_name")):
        if col in df.columns:
            out[key] = X.top_values(df, col, 10)
    if "event_data" in df.columns:
        out["daily_counts"] = T.daily_counts(df, "event_data")
    return out
