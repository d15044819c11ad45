"""Property tests over generated event frames."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vacancy_spark.operators import compare as H
from vacancy_spark.operators import filters as FL
from vacancy_spark.operators import metrics as M

NAMES = ["job_visit", "job_apply_start", "other"]
rows_st = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c", "d", "e", "f"]),
              st.sampled_from([dt.date(2024, 1, d) for d in (1, 2, 3)]),
              st.sampled_from(NAMES),
              st.sampled_from(["North", "South", "East"]),
              st.sampled_from(["i1", "i2"])),
    min_size=1, max_size=40)
SCHEMA = "entity_id string, event_date date, event_name string, uk_region string, importer_name string"
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(rows=rows_st)
def test_benchmark_rows_sum_to_totals(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    tot = M.kpi_metrics(df).first()
    b = M.benchmark(df, "uk_region").collect()
    assert sum(r["total_clicks"] for r in b) == tot["total_clicks"]
    assert sum(r["total_applies"] for r in b) == tot["total_applies"]


@SETTINGS
@given(rows=rows_st)
def test_quartiles_partition_vacancies(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    q = M.quartile_metrics(df).collect()
    n = df.select("entity_id").distinct().count()
    if n < 4:
        assert q == []
    else:
        assert sum(r["num_vacancies"] for r in q) == n


@SETTINGS
@given(rows=rows_st)
def test_equal_specs_compare_to_zero(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    spec = FL.FilterSpec(region=("North", "East"))
    out = H.compare(df, spec, spec).collect()
    assert all(r["diff"] == 0 and r["direction"] == "equal" for r in out)


@SETTINGS
@given(rows=rows_st)
def test_filters_commute(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    a = FL.FilterSpec(region=("North",))
    b = FL.FilterSpec(importer=("i1",))
    ab = FL.apply_filters(FL.apply_filters(df, a), b)
    ba = FL.apply_filters(FL.apply_filters(df, b), a)
    both = FL.apply_filters(df, FL.FilterSpec(region=("North",), importer=("i1",)))
    assert sorted(ab.collect()) == sorted(ba.collect()) == sorted(both.collect())
