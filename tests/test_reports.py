"""The report bundles over a table of the enriched schema."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from vacancy_spark.operators.filters import FilterSpec
from vacancy_spark.plans import reports as RP
from vacancy_spark.plans.enrich import enriched_events
from vacancy_spark.plans.materialize import job_events_table
from vacancy_spark.plans.tables import export_csv
from vacancy_spark.session import fresh_path
from vacancy_spark.sources import fixtures as FX


def test_report_bundles_match_registered_path(spark):
    table = job_events_table(spark, SF_SMALL)
    mapping = fresh_path(spark, "mapping")
    FX.importer_mapping_rows(spark).coalesce(1).write.option("header", True).csv(mapping)
    df = RP.load_report_frame(spark, table, "2024-01-31", mapping_path=mapping)
    want = enriched_events(spark, SF_SMALL)
    assert sorted(RP.overview(df)["kpis"].collect()) == sorted(RP.overview(want)["kpis"].collect())
    spec = FilterSpec(region=("ASIA", "EUROPE"))
    for name, frame in RP.overview(df, spec).items():
        frame.collect()
    dd = RP.deep_dive(df, spec, "Region")
    assert {r["uk_region"] for r in dd["benchmark"].collect()} <= {"ASIA", "EUROPE"}
    vp = RP.vacancy_performance(df, "2024-01-31", spec)
    assert vp["totals"].first()["total_vacancies"] == vp["report"].count()
    cmp = RP.comparison(df, FilterSpec(), spec)["summary"].collect()
    assert len(cmp) == 6


def test_legacy_frame_regions_before_merge(spark):
    t = job_events_table(spark, SF_SMALL)
    raw = t.select(F.col("entity_id_str").alias("entity_id"), "event_date", "event_name",
                   "organization_name", F.col("locations").alias("regions"),
                   F.col("importer_ID").alias("importer_id"), "upgrades")
    src = fresh_path(spark, "raw_events")
    raw.write.parquet(src)
    export = fresh_path(spark, "export")
    export_csv(FX.job_export(spark, SF_SMALL), export)
    df = RP.load_legacy_frame(spark, src, "2024-01-31", export_path=export)
    assert {"uk_region", "location_full", "start_date", "importer_name"} <= set(df.columns)
    # regions come from the raw address (the export's location is the same for all rows)
    assert df.select("uk_region").distinct().count() > 1
    assert dict(df.schema.fields and [(f.name, f.dataType.simpleString()) for f in df.schema.fields])["event_date"] == "date"
    for frame in RP.legacy_overview(df).values():
        frame.collect()


def test_threshold_reports_over_csv_mapping(spark):
    """Subqueries over a frame whose lookup came from a CSV (a non-deterministic plan)."""
    from vacancy_spark.operators import metrics as M
    mapping = fresh_path(spark, "mapping2")
    FX.importer_mapping_rows(spark).coalesce(1).write.option("header", True).csv(mapping)
    df = RP.load_report_frame(spark, job_events_table(spark, SF_SMALL), "2024-01-31", mapping_path=mapping)
    want = enriched_events(spark, SF_SMALL)
    for fn in (M.quartile_metrics, M.iqr_mean, lambda d: M.benchmark_bands(d, "importer_name")):
        assert sorted(fn(df).collect()) == sorted(fn(want).collect())


def test_filtered_vacancy_report_equals_two_pass(spark):
    from vacancy_spark.operators import vacancy as V
    from vacancy_spark.operators.filters import apply_filters
    full = enriched_events(spark, SF_SMALL)
    for spec in (FilterSpec(importer=("Scrape", "ID: 0")), FilterSpec(job_title="red"),
                 FilterSpec(date_range=("2024-01-10", "2024-01-12"), region=("ASIA",)),
                 FilterSpec(importer=("nobody",))):
        one = V.vacancy_report_filtered(full, spec, "2024-01-31")
        two = V.vacancy_report(apply_filters(full, spec), "2024-01-31", full)
        assert sorted(one.collect()) == sorted(two.collect())
    plan = V.vacancy_report_filtered(full, FilterSpec(importer=("Scrape", "ID: 0")), "2024-01-31")
    assert plan.count() > 0
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "/enriched/" not in text  # both branches read the stored vacancy counts
    assert text.count("FileScan parquet") == text.count("vacancy_counts-") > 0


def test_sheet_flow(spark):
    from vacancy_spark.plans.registry import _sheet_frame
    path = fresh_path(spark, "sheet")
    export_csv(_sheet_frame(spark, SF_SMALL), path)
    df = RP.load_sheet_frame(spark, path)
    out = RP.sheet_overview(df)
    assert set(out) == {"cards", "top_occupations", "top_regions", "top_importers", "daily_counts"}
    cards = out["cards"].first()
    assert cards["total_records"] == df.count() > 0
    assert out["daily_counts"].count() > 0
    assert out["top_importers"].count() <= 10
