"""No raw event is sorted or shuffled whole where counts are asked for, and scans are pruned."""

import re

import pytest

from conftest import SF_SMALL
from vacancy_spark.operators import cross, joins, vacancy
from vacancy_spark.plans import registry, tables
from vacancy_spark.plans.enrich import enriched_events, legacy_events
from vacancy_spark.plans.materialize import job_export_table
from vacancy_spark.sources.events import scan_events_legacy


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def above_scans(p: str, table: str) -> list[list[str]]:
    """The operators above each scan that reads ``table``, from the scan upwards to the first
    exchange or the root."""
    lines = [x for x in p.split("\n") if re.match(r"[ :]*[+:]- ", x)]  # not the rest of wrapped ones
    depth = [re.search(r"[A-Za-z(*]", x).start() for x in lines]
    found = []
    for i, x in enumerate(lines):
        if "Scan parquet" in x and table in x:  # FileScan names its folder and columns
            names, at = [], depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < at:
                    at = depth[j]
                    names.append(lines[j])
                    if "Exchange" in lines[j]:
                        break
            found.append(names)
    return found


@pytest.fixture()
def shuffle_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def check_reduced_before_exchange(p: str):
    """Between a scan of the events and the first exchange stands a hash aggregate and no sort."""
    paths = [x for x in above_scans(p, "enriched") or above_scans(p, "event_date") if x and "Exchange" in x[-1]]
    assert paths, p
    for x in paths:
        assert any("HashAggregate" in n for n in x), (x, p)
        assert not any(re.search(r"SortAggregate|\bSort\b", n) for n in x), (x, p)


@pytest.mark.parametrize("key", ["vacancy_days_active", "occupation_benchmark", "job_details", "vacancy_view",
                                 "vacancy_table_changing"])
def test_events_are_counted_before_anything_is_sorted(spark, key):
    check_reduced_before_exchange(plan(registry.QUERIES[key](spark, SF_SMALL)))


@pytest.mark.parametrize("key", ["vacancy_report_legacy", "filter_vacancy_table"])
def test_legacy_reports_aggregate_before_the_join(spark, key, shuffle_joins):
    check_reduced_before_exchange(plan(registry.QUERIES[key](spark, SF_SMALL)))


@pytest.mark.parametrize("key", ["unmatched_events", "key_mismatch", "importer_mapping"])
def test_key_audits_shuffle_no_raw_events(spark, key, shuffle_joins):
    check_reduced_before_exchange(plan(registry.QUERIES[key](spark, SF_SMALL)))


def test_null_keys_are_unmatched(spark):
    events = spark.createDataFrame([(None,), (None,), ("a",), ("b",), ("b",)], "entity_id string")
    meta = spark.createDataFrame([("a",), ("c",), (None,)], "entity_id string")
    assert joins.unmatched_events(events, meta).first()[0] == 4
    assert sorted(map(tuple, joins.key_mismatch(events, meta).collect())) == [
        ("b", "events_only"), ("c", "metadata_only")]
    assert joins.unmatched_events(events.where("false"), meta).first()[0] == 0


def test_legacy_report_multiplies_by_matching_export_rows(spark):
    events = spark.createDataFrame(
        [("1", "20240101", "job_visit", "old", "o", "Leeds"), ("1", "20240102", "job_apply_start", "new", "o", "Leeds"),
         ("2", "20240101", "job_visit", "t", "o", "x")],
        "entity_id string, event_date string, event_name string, title string, organization_name string, regions string")
    export = spark.createDataFrame([("1", "e", "d1", "d2", "p", "a, Leeds"), ("1", "e", "d3", "d2", "p", "b, London")],
                                   "job_id string, title string, publishing_date string, expiration_date string, "
                                   "organization_profile_name string, locations string")
    merged = joins.merge_job_export(events, export, regions=True)
    want = vacancy.vacancy_report_legacy(merged).collect()
    assert vacancy.vacancy_report_legacy(events, export=export).collect() == want
    assert [(r.job_id, r.title, r.start_date, r.total_clicks, r.total_apply_start, r.region) for r in want] == [
        ("1", "new", "d3", 2, 2, "London"), ("2", "t", None, 1, 0, "Unknown")]


def test_partitions_are_pruned(spark, scratch):
    legacy = legacy_events(spark, SF_SMALL, with_day=True)
    out = scan_events_legacy(legacy, "2024-01-31", days_back=14, order=False, day_col="event_date_parsed")
    assert re.search(r"PartitionFilters: \[.*event_date_parsed", plan(out))
    odd = spark.createDataFrame([("20240120", "a"), ("20190101", "b"), ("99990101", "c"), ("x", "d"), (None, "e")],
                                "event_date string, entity_id string")
    table = tables.rebuild_range_partitioned(odd, scratch)
    assert {r.event_date_bucket for r in table.collect()} == {4, -1, None}
    out = scan_events_legacy(table, "2024-01-31", days_back=14, order=False)
    assert re.search(r"PartitionFilters: \[.*event_date_bucket", plan(out))
    assert {r.entity_id for r in out.collect()} == {"a", "c", "d"}  # as the text comparison has it


def test_heatmap_takes_its_labels_from_the_data(spark, monkeypatch):
    df = enriched_events(spark, SF_SMALL)
    labels = {r[0] for r in df.select("importer_name").distinct().collect()}
    assert set(cross.heatmap(df).columns) - {"uk_region"} == labels
    monkeypatch.setattr(cross, "MAX_PIVOT_LABELS", len(labels) - 1)
    with pytest.raises(ValueError):
        cross.heatmap(df)


def test_region_parser_runs_on_the_export(spark, shuffle_joins):
    p = plan(vacancy.vacancy_report_legacy(legacy_events(spark, SF_SMALL), export=job_export_table(spark, SF_SMALL)))
    assert "importer_name" not in p
