"""Sources, sinks and table maintenance on small frames."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vacancy_spark.plans import tables as TB
from vacancy_spark.session import fresh_path, local_path
from vacancy_spark.sources import files as FS
from vacancy_spark.sources import fixtures as FX


def test_snapshot_keeps_newest(spark, scratch):
    df = spark.range(5)
    for h in range(5):
        out = TB.snapshot_table(spark, df, scratch, "report", dt.datetime(2024, 1, 31, h), keep=3)
    names = TB.list_backups(spark, scratch, "report")
    assert names == ["report_backup_2024-01-31_0400", "report_backup_2024-01-31_0300",
                     "report_backup_2024-01-31_0200"]
    assert spark.read.parquet(out["current"]).count() == 5


def test_snapshot_archive_variant(spark, scratch):
    df = spark.range(3)
    out = TB.snapshot_table(spark, df, scratch, "extract", "2024-01-31 10:15", archive_source=df)
    assert out["archive"].endswith("extract_source_backup_2024-01-31_1015")


def test_merge_update_semantics_and_duplicate_guard(spark, scratch):
    tgt = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "k string, v string, w string")
    src = spark.createDataFrame([("1", None)], "k string, v string")
    got = {r["k"]: r["v"] for r in TB.merge_update(tgt, src, "k", ["v"]).collect()}
    assert got == {"1": None, "2": "b"}
    dup = spark.createDataFrame([("1", "p"), ("1", "q")], "k string, v string")
    with pytest.raises(Exception):
        TB.merge_update(tgt, dup, "k", ["v"]).collect()


def test_overwrite_keeps_old_columns(spark, scratch):
    spark.createDataFrame([(1, "old")], "id int, note string").write.parquet(scratch)
    back, n = TB.overwrite_table(spark, spark.createDataFrame([(2, 3.5)], "id int, score double"), scratch)
    assert n == 1
    assert set(back.columns) == {"id", "note", "score"}
    assert back.first()["note"] is None


def test_range_bucket(spark):
    df = spark.createDataFrame([(20191231,), (20200101,), (20241231,), (20300101,), (None,)], "d bigint")
    got = [r[0] for r in df.select(TB.range_bucket("d", 20200101, 20301231, 10000)).collect()]
    assert got == [-1, 0, 4, -1, None]


def test_strict_date_parse_fails(spark):
    from vacancy_spark.functions.dates import parse_yyyymmdd
    df = spark.createDataFrame([("2024-01-01",)], "d string")
    assert df.select(parse_yyyymmdd("d")).first()[0] is None
    with pytest.raises(Exception):
        df.select(parse_yyyymmdd("d", strict=True)).collect()


def test_mapping_csv_with_bom(spark, scratch):
    os.makedirs(local_path(scratch), exist_ok=True)
    p = os.path.join(local_path(scratch), "mapping.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write("importer_id,importer_name\n2, ATS feed \n,blank\n5,Civil Service\n2,ATS v2\n")
    m = {r["importer_id"]: r["importer_name"] for r in FS.read_importer_mapping(spark, p).collect()}
    assert m == {"2": "ATS v2", "5": "Civil Service"}


def test_missing_export_is_empty(spark, scratch):
    df = FS.read_job_export(spark, scratch + "/nothing.csv")
    assert df.count() == 0 and "job_id" in df.columns


def test_load_csv_replace_stats(spark):
    src = fresh_path(spark, "csv_src")
    TB.export_csv(FX.job_export(spark, SF_SMALL), src)
    loaded, stats = FS.load_csv_replace(spark, src, fresh_path(spark, "csv_dst"))
    assert stats["rows"] == loaded.count() > 0
    assert stats["columns"] == 8 and stats["bytes"] > 0


def test_metadata_null_key_rejected(spark):
    loc = fresh_path(spark, "meta")
    name = "meta_nullkey_test"
    FS.create_metadata_table(spark, name, loc)
    bad = spark.createDataFrame([(None,)], "entity_id string").select(
        "entity_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in
                       __import__("vacancy_spark.schema", fromlist=["x"]).JOB_METADATA_SCHEMA.fields[1:]])
    with pytest.raises(Exception):
        FS.write_metadata(bad, name)


def test_require_table(spark):
    from vacancy_spark.sources.events import require_table
    with pytest.raises(LookupError):
        require_table(spark, "no_such_table_here")


def test_empty_result_flows_through(spark):
    from vacancy_spark.operators import filters as FL
    from vacancy_spark.operators import vacancy as V
    from vacancy_spark.plans.enrich import enriched_events
    df = enriched_events(spark, SF_SMALL)
    empty = FL.apply_filters(df, FL.FilterSpec(importer=("no such importer",)))
    assert V.vacancy_report(empty, "2024-01-31", df).count() == 0
    assert V.vacancy_totals(V.vacancy_report(empty, "2024-01-31", df)).first()["total_vacancies"] == 0


def test_scan_row_cap_and_legacy_order(spark):
    from vacancy_spark.plans.enrich import legacy_events
    from vacancy_spark.plans.materialize import job_events_table
    from vacancy_spark.sources.events import scan_events, scan_events_legacy
    assert scan_events(job_events_table(spark, SF_SMALL), "2024-01-31", sample_size=7).count() == 7
    dates = [r[0] for r in scan_events_legacy(legacy_events(spark, SF_SMALL), "2024-01-31").select("event_date").collect()]
    assert dates == sorted(dates, reverse=True)


def test_select_columns_defaults(spark):
    from vacancy_spark.operators.clean import select_columns
    df = spark.createDataFrame([(1, "x", "y")], "event_date int, event_name string, other string")
    assert select_columns(df).columns == ["event_date", "event_name"]
    assert select_columns(df, ["other", "missing"]).columns == ["other"]
    assert select_columns(df.select("other")).columns == ["other"]


def test_all_string_read_and_empty_error(spark, scratch):
    os.makedirs(local_path(scratch), exist_ok=True)
    good = os.path.join(local_path(scratch), "sheet.csv")
    with open(good, "w") as f:
        f.write("event_data,importer_id\n20240105,2\n")
    df = FS.read_all_string(spark, good)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "string"]
    empty = os.path.join(local_path(scratch), "empty.csv")
    open(empty, "w").close()
    with pytest.raises(Exception):
        FS.read_all_string(spark, empty)


def test_card_metrics_absent_columns(spark):
    from vacancy_spark.operators.metrics import card_metrics
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "organization_name string")
    r = card_metrics(df).first()
    assert (r["total_records"], r["unique_organizations"], r["unique_occupations"], r["unique_regions"]) == (3, 2, 0, 0)


def test_cluster_settings_sizes_partitions():
    from vacancy_spark.session import cluster_settings
    big = cluster_settings(100 * 10**12)
    assert int(big["spark.sql.shuffle.partitions"]) == -(-100 * 10**12 // (256 << 20))
    small = cluster_settings(10**9, executor_cores=8, executor_memory_gb=2)
    assert int(small["spark.sql.files.maxPartitionBytes"]) == 64 << 20


def test_replace_path_keeps_old_table_when_write_fails(spark, scratch):
    spark.range(3).write.parquet(scratch)

    def failing(staged):
        spark.range(5).write.parquet(staged)
        raise RuntimeError("job lost")

    with pytest.raises(RuntimeError):
        TB.replace_path(spark, scratch, failing)
    assert spark.read.parquet(scratch).count() == 3
    TB.replace_path(spark, scratch, lambda staged: spark.range(7).write.parquet(staged))
    assert spark.read.parquet(scratch).count() == 7


def test_heatmap_discovers_columns(spark):
    from vacancy_spark.operators.cross import heatmap
    from vacancy_spark.plans.enrich import enriched_events
    df = enriched_events(spark, SF_SMALL)
    h = heatmap(df, "apply_click_ratio")
    names = [r[0] for r in df.select("importer_name").distinct().collect()]
    assert set(h.columns) == {"uk_region", *names}
    with pytest.raises(ValueError):
        heatmap(df, "nonsense")


def test_repeatable_sample(spark):
    from vacancy_spark.plans.materialize import job_events_table
    from vacancy_spark.sources.events import scan_events
    t = job_events_table(spark, SF_SMALL)
    a = scan_events(t, "2024-01-31", sample_size=25, repeatable=True)
    b = scan_events(t.repartition(3), "2024-01-31", sample_size=25, repeatable=True)
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 25
    assert "TakeOrderedAndProject" in a._jdf.queryExecution().executedPlan().toString()


def test_export_names():
    assert TB.export_name("benchmark_region", "2024-01-31 09:05:07") == "benchmark_region_20240131.csv"
    assert TB.export_name("vacancy_report", "2024-01-31 09:05:07", with_time=True) == \
        "vacancy_report_20240131_090507.csv"
