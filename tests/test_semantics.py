"""Unit tests on tiny frames for the semantics notes S1-S14 (FIXTURES section 4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vacancy_spark.functions.dates import parse_dmy_hm
from vacancy_spark.functions.regions import region_from_address, region_from_locations
from vacancy_spark.operators import clean as C
from vacancy_spark.operators import filters as FL
from vacancy_spark.operators import metrics as M
from vacancy_spark.operators import vacancy as V

EV = "entity_id string, event_date date, event_name string, uk_region string"
D1 = dt.date(2024, 1, 2)


def ev(spark, rows, schema=EV):
    return spark.createDataFrame(rows, schema)


def test_s1_null_dimension_row_is_zero(spark):
    df = ev(spark, [("a", D1, "job_visit", None), ("b", D1, "job_visit", None),
                    ("c", D1, "job_visit", "London")])
    rows = {r["uk_region"]: r for r in M.benchmark(df, "uk_region").collect()}
    assert rows[None]["vacancies"] == 0 and rows[None]["total_clicks"] == 0
    assert rows[None]["mean_clicks_per_vac"] == 0.0
    assert rows["London"]["vacancies"] == 1 and rows["London"]["total_clicks"] == 1
    kept = {r["uk_region"]: r for r in M.benchmark(df, "uk_region", null_group="keep").collect()}
    assert kept[None]["vacancies"] == 2
    dropped = M.benchmark(df, "uk_region", null_group="drop").collect()
    assert [r["uk_region"] for r in dropped] == ["London"]


def test_s2_null_entity(spark):
    df = ev(spark, [("a", D1, "job_visit", "x"), ("a", D1, "job_visit", "x"), (None, D1, "job_visit", "x")])
    k = M.kpi_metrics(df).first()
    assert k["num_vacancies"] == 1
    assert k["total_clicks"] == 3
    assert k["median_clicks_per_vacancy"] == 1.0  # inputs 2 and 0


def test_s4_days_active_whole_days(spark):
    df = spark.createDataFrame(
        [("a", D1, "job_visit", dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1), "published"),
         ("b", D1, "job_visit", dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 3, 12), "published"),
         ("c", D1, "job_visit", dt.datetime(2024, 1, 1, 0), None, "published"),
         ("d", D1, "job_visit", dt.datetime(2024, 1, 1, 0), None, "unpublished")],
        "entity_id string, event_date date, event_name string, start_date timestamp_ntz, "
        "end_date timestamp_ntz, workflow_state string")
    got = {r["job_id"]: r["days_active"] for r in V.days_active(df, "2024-01-31").collect()}
    assert got == {"a": None, "b": 2, "c": 30, "d": None}


def test_s6_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125,), (2.5,), (1 / 800 * 100,)], "x double")
    got = [r[0] for r in df.select(F.bround("x", 2)).collect()]
    assert got == [0.12, 2.5, 0.12]


def test_s7_title_regex_and_literal(spark):
    df = spark.createDataFrame([("Housing (Director)",), ("C++ dev",), (None,)], "title string")
    with pytest.raises(Exception):
        FL.apply_filters(df, FL.FilterSpec(job_title="(")).collect()
    lit = FL.apply_filters(df, FL.FilterSpec(job_title="(", title_regex=False)).collect()
    assert [r[0] for r in lit] == ["Housing (Director)"]
    rx = FL.apply_filters(df, FL.FilterSpec(job_title="  HOUSING ")).collect()
    assert [r[0] for r in rx] == ["Housing (Director)"]


def test_s8_empty_filters_are_identity(spark):
    df = spark.createDataFrame([("x", D1)], "importer_name string, event_date date")
    assert FL.apply_filters(df, FL.FilterSpec(importer=(), date_range=(D1,))) is df
    assert FL.apply_filters(df, None) is df
    nul = spark.createDataFrame([(None, D1)], "importer_name string, event_date date")
    assert FL.apply_filters(nul, FL.FilterSpec(importer=("x",))).count() == 0


def test_s9_quartile_ties(spark):
    rows = [(e, D1, "job_visit", "r") for e in "abcd" for _ in range(3)]
    q = {r["quartile"]: r for r in M.quartile_metrics(ev(spark, rows)).collect()}
    assert q["top_25"]["num_vacancies"] == 4
    assert q["middle_50"]["num_vacancies"] == 0 and q["bottom_25"]["num_vacancies"] == 0
    three = [(e, D1, "job_visit", "r") for e in "abc"]
    assert M.quartile_metrics(ev(spark, three)).count() == 0


def test_s10_first_row_is_newest_day(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), "old title"), ("a", dt.date(2024, 1, 5), "new title")],
                               "entity_id string, event_date date, title string")
    assert C.first_row_per(df, "entity_id").first()["title"] == "new title"


@pytest.mark.parametrize("addr,reference,area", [
    ("England, Leicester, GB", "East Midlands", "East Midlands"),
    ("1 High St, Leicester LE1 5YA", "London", "East Midlands"),
    ("Kirkstall LS5 3BT", "Unknown", "Yorkshire and the Humber"),
    ("SW1A 1AA", "London", "London"),  # keyword "sw1" matches in both modes
    ("", "Unknown", "Unknown"),
    (None, "Unknown", "Unknown"),
    ("Nowhere", "Unknown", "Unknown"),
    ("Somewhere, Doncaster, GB", "Yorkshire and the Humber", "Yorkshire and the Humber"),
])
def test_s11_region_parser(spark, addr, reference, area):
    df = spark.createDataFrame([(addr,)], "a string")
    r = df.select(region_from_address("a").alias("ref"), region_from_address("a", "area").alias("area")).first()
    assert (r["ref"], r["area"]) == (reference, area)


def test_s11_duplicate_postcode_keys_last_wins(spark):
    df = spark.createDataFrame([("DN1 2AB",), ("SY1 1AA",)], "a string")
    got = [r[0] for r in df.select(region_from_address("a", "area")).collect()]
    assert got == ["Yorkshire and the Humber", "Wales"]


def test_s12_multi_location_first_known(spark):
    df = spark.createDataFrame([("Paris, , FR | Wales, Cardiff, GB",), ("Nowhere | Nada",), (None,)], "a string")
    got = [r[0] for r in df.select(region_from_locations("a")).collect()]
    assert got == ["Wales", "Unknown", "Unknown"]


def test_s13_left_join_fans_out_unless_deduplicated(spark):
    from vacancy_spark.operators.joins import merge_job_export
    events = spark.createDataFrame([("1", "job_visit")], "entity_id string, event_name string")
    export = spark.createDataFrame([("1", "t1", "a", "b", "o", "l"), ("1", "t2", "a", "b", "o", "l")],
                                   "job_id string, title string, publishing_date string, "
                                   "expiration_date string, organization_profile_name string, locations string")
    assert merge_job_export(events, export).count() == 2
    dedup = C.dedup_latest(export, "job_id", "title")
    assert merge_job_export(events, dedup).count() == 1


def test_s14_average_apply_rate_current_vs_legacy(spark):
    rows = [("a", D1, "job_visit"), ("a", D1, "job_visit"), ("a", D1, "job_apply_start"), ("b", D1, "job_view")]
    df = spark.createDataFrame(rows, "entity_id string, event_date date, event_name string")
    cur = df.withColumns({"title": F.lit("t"), "organization_name": F.lit("o"), "workflow_state": F.lit("x"),
                          "start_date": F.lit(None).cast("timestamp_ntz"),
                          "end_date": F.lit(None).cast("timestamp_ntz"), "uk_region": F.lit("r"),
                          "occupation": F.lit("occ"), "importer_name": F.lit("i"),
                          "upgrades_list": F.array().cast("array<string>")})
    rep = V.vacancy_report(cur, "2024-01-31")
    assert V.vacancy_totals(rep).first()["avg_apply_rate"] == 50.0
    leg = V.vacancy_report_legacy(df)
    assert V.vacancy_totals(leg, "total_clicks", "total_apply_start",
                            "apply_click_ratio_pct").first()["avg_apply_rate"] == 25.0


def test_b3_parse_upgrades(spark):
    df = spark.createDataFrame([("a | b||c",), ("  ",), (None,)], "upgrades string")
    got = [r[0] for r in C.parse_upgrades(df).select("upgrades_list").collect()]
    assert got == [["a", "b", "", "c"], [], []]


def test_b5_primary_occupation(spark):
    df = spark.createDataFrame([(" Nurse | Doctor",), ("  ",), (None,)], "occupational_fields string")
    got = [r[0] for r in C.add_occupation(df).select("occupation").collect()]
    assert got == ["Nurse", "Unknown", "Unknown"]


def test_b8_day_first_timestamps(spark):
    df = spark.createDataFrame([("1/2/2024 9:30",), ("bad",), ("25/12/2023 17:05",)], "s string")
    got = [r[0] for r in df.select(parse_dmy_hm("s")).collect()]
    assert got == [dt.datetime(2024, 2, 1, 9, 30), None, dt.datetime(2023, 12, 25, 17, 5)]


def test_b2_importer_mapping_fallbacks(spark):
    df = spark.createDataFrame([(2,), (9,), (None,)], "importer_ID bigint")
    m = C.clean_importer_mapping(spark.createDataFrame([(" 2 ", " ATS feed "), ("", "blank")],
                                                       "importer_id string, importer_name string"))
    got = [r[0] for r in C.apply_importer_mapping(df, m).select("importer_name").collect()]
    assert got == ["ATS feed", "ID: 9", "ID: <NA>"]
    raw = [r[0] for r in C.apply_importer_mapping(df, m, fallback="raw").select("importer_name").collect()]
    assert raw == ["ATS feed", "9", "<NA>"]
    none = [r[0] for r in C.apply_importer_mapping(df, None).select("importer_name").collect()]
    assert none == ["ID: 2", "ID: 9", "ID: <NA>"]
    absent = C.apply_importer_mapping(df.drop("importer_ID"), m)
    assert absent.first()["importer_name"] == "Unknown"


def test_mapping_last_duplicate_wins(spark):
    m = spark.createDataFrame([("1", "first"), ("1", "second")], "importer_id string, importer_name string")
    assert C.clean_importer_mapping(m.coalesce(1)).first()["importer_name"] == "second"


def test_strip_matches_python(spark):
    s = " \t x y 　\n"
    from vacancy_spark.functions.text import trim_ws
    got = spark.createDataFrame([(s,)], "s string").select(trim_ws("s")).first()[0]
    assert got == s.strip()


def test_sheet_ids_are_not_stripped(spark):
    df = spark.createDataFrame([(" 2",), ("2",)], "importer_id string")
    m = C.clean_importer_mapping(spark.createDataFrame([("2", "ATS feed")], "importer_id string, importer_name string"))
    got = [r[0] for r in C.apply_importer_mapping(df, m, id_col="importer_id", fallback="raw",
                                                  strip_ids=False).select("importer_name").collect()]
    assert got == [" 2", "ATS feed"]
