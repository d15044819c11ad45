"""Plan checks: no Python evaluation, filters and columns reach the scan, partitions pruned,
lookups broadcast, one shuffle per report where one suffices."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from vacancy_spark.plans import registry
from vacancy_spark.plans.enrich import legacy_events
from vacancy_spark.plans.tables import rebuild_typed_events
from vacancy_spark.sources.events import scan_events


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_no_python_udfs(spark, key):
    p = plan(E.queries()[key](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                 "PythonUDF"):
        assert node not in p, f"{key} runs Python: {node}"


def test_scan_pushdown_and_pruning(spark, scratch):
    from vacancy_spark.sources import fixtures as FX
    FX.job_events(spark, SF_SMALL).write.partitionBy("event_date_parsed").parquet(scratch)
    out = scan_events(spark.read.parquet(scratch), "2024-01-31", days_back=5)
    p = plan(out.select("entity_id_str", "event_name"))
    assert "PartitionFilters: [isnotnull(event_date_parsed" in p
    assert "PushedFilters: [In(event_name" in p
    assert "ReadSchema: struct<entity_id_str:string,event_name:string>" in p


def test_typed_rebuild_is_partitioned(spark, scratch):
    typed = rebuild_typed_events(legacy_events(spark, SF_SMALL), scratch)
    p = plan(typed.where(F.col("event_date_parsed") == F.lit("2024-01-05").cast("date")))
    assert "PartitionFilters: [isnotnull(event_date_parsed" in p


def test_enrich_lookup_is_broadcast(spark):
    p = plan(E.queries()["importer_names_raw"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p


def test_vacancy_report_single_shuffle_on_entity(spark):
    df = E.queries()["vacancy_counts"](spark, SF_SMALL)
    p = plan(df)
    assert p.count("HashAggregate") >= 2  # partial + final


@pytest.mark.parametrize("key", ["quartile_metrics", "iqr_filter"])
def test_threshold_subquery_reuses_the_vacancy_shuffle(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in p and "hashpartitioning(entity_id" in p


def test_legacy_scan_pushes_integer_dates(spark, scratch):
    from vacancy_spark.sources.events import scan_events_legacy
    df = legacy_events(spark, SF_SMALL).withColumn("event_date", F.col("event_date").cast("bigint"))
    df.write.parquet(scratch)
    out = scan_events_legacy(spark.read.parquet(scratch), "2024-01-31", days_back=14, order=False)
    assert "GreaterThanOrEqual(event_date,20240117)" in plan(out)
    strings = legacy_events(spark, SF_SMALL)
    assert out.count() == scan_events_legacy(strings, "2024-01-31", days_back=14).count()
