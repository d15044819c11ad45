"""Ranges that a table knows, daily counts, bucketed tables, the address dictionary: results and plans."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vacancy_spark.functions.regions import region_from_address, region_from_locations
from vacancy_spark.operators import compare as H
from vacancy_spark.operators import cross as X
from vacancy_spark.operators import filters as FL
from vacancy_spark.operators import joins as J
from vacancy_spark.operators import metrics as M
from vacancy_spark.operators import trends as T
from vacancy_spark.operators import vacancy as V
from vacancy_spark.plans import addresses as AD
from vacancy_spark.plans import bucketed as BK
from vacancy_spark.plans import daily as DY
from vacancy_spark.plans import published as PB
from vacancy_spark.plans import reports, tables
from vacancy_spark.plans.enrich import enriched_events, legacy_events
from vacancy_spark.sources.events import scan_events_legacy
from vacancy_spark.sources.ranges import RangePartitions, read_ranges


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- ranges ------------------------------------------------------------------------------------------

ODD_DAYS = ["20240120", "20240117", "20240116", "20190101", "99990101", "x", None, "9", "5", "202401", "020240120", " 20240120",
            "2024-01-20", "20240120.0", "+20240120", "20240101", "20231231", "100000000", "19991231", "-20240120", ""]


@pytest.mark.parametrize("start,stop,step", [(20200101, 20301231, 10000), (20240101, 20241231, 100), (20240115, 20240125, 1),
                                             (1, 30000000, 100000), (20240121, 20240131, 7)])
@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_ranges_of_any_step(spark, scratch, start, stop, step, kind):
    df = spark.createDataFrame([(d, str(i)) for i, d in enumerate(ODD_DAYS)], "event_date string, entity_id string")
    if kind == "bigint":
        df = df.withColumn("event_date", F.col("event_date").try_cast("bigint"))
    table = tables.rebuild_range_partitioned(df, scratch, start, stop, step)
    assert read_ranges(spark, scratch) == RangePartitions("event_date", start, stop, step)
    want = rows(scan_events_legacy(df, "2024-01-31", days_back=14, order=False))
    for source in (table, scratch):
        out = scan_events_legacy(source, "2024-01-31", days_back=14, order=False)
        assert rows(out.drop("event_date_bucket")) == want
        assert re.search(r"PartitionFilters: \[[^\]]*event_date_bucket", plan(out))
    frame = scan_events_legacy(table.where("entity_id >= ''"), "2024-01-31", days_back=14, order=False)
    assert not re.search(r"PartitionFilters: \[[^\]]*event_date_bucket", plan(frame))  # no descriptor, no pruning
    assert rows(frame.drop("event_date_bucket")) == want


def test_ranges_leave_out_folders(spark, scratch):
    df = spark.createDataFrame([(f"2024{m:02}{d:02}", "a") for m in (1, 2, 3) for d in range(1, 29)], "event_date string, entity_id string")
    table = tables.rebuild_range_partitioned(df, scratch, 20240101, 20241231, 100)
    out = scan_events_legacy(table, "2024-03-10", days_back=3, order=False)
    assert {r.event_date_bucket for r in out.select("event_date_bucket").distinct().collect()} == {2}
    kept = table.where(RangePartitions("event_date", 20240101, 20241231, 100).from_on(20240307, text=True))
    assert {r.event_date_bucket for r in kept.select("event_date_bucket").distinct().collect()} == {2}
    for bad in ((1, 0, 1), (1, 10, 0), (1, 10, -1)):
        with pytest.raises(ValueError):
            RangePartitions("event_date", *bad)


# -- daily counts --------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def stored(spark):
    from vacancy_spark.session import fresh_path
    events, path = enriched_events(spark, SF_SMALL), fresh_path(spark, "daily-test")
    DY.add_days(events, path)
    return events, path


SPECS = [FL.FilterSpec(), FL.FilterSpec(date_range=("2024-01-08", "2024-01-21"), upgrades=("Featured job",), job_title="  Red|BLUE b"),
         FL.FilterSpec(date_range=("2024-01-03", "2024-01-03"), importer=("ATS feed", "ID: 0"), event_names=("job_visit",))]


@pytest.mark.parametrize("spec", SPECS)
def test_daily_counts_stand_for_the_events(spark, stored, spec):
    events, path = stored
    day = DY.daily(spark, path)
    a, b = FL.apply_filters(events, spec), FL.apply_filters(day, spec)
    for f in (M.kpi_metrics, M.basic_totals, T.daily_trend, lambda d: M.vacancy_counts(d, "occupation"),
              lambda d: M.benchmark(d, "uk_region"), lambda d: V.vacancy_report(d, "2024-01-31")):
        assert rows(f(b)) == rows(f(a))
    if spec == SPECS[0]:
        other = FL.FilterSpec(importer=("ATS feed",))
        for f in (lambda d: H.compare(d, other, None), lambda d: H.compare_long(d, None, other), T.daily_counts, M.dataset_totals,
                  T.daily_trend_outer_join, lambda d: X.value_counts(d, "uk_region"), lambda d: X.top_values(d, "occupation", 5),
                  X.importer_record_counts, lambda d: M.card_metrics(d, region="uk_region"), lambda d: X.heatmap(d, "apply_click_ratio")):
            assert rows(f(day)) == rows(f(events))
    assert rows(V.vacancy_report_filtered(day, spec, "2024-01-31")) == rows(V.vacancy_report_filtered(events, spec, "2024-01-31"))


def test_daily_counts_read_no_event(spark, stored):
    _, path = stored
    p = plan(M.kpi_metrics(FL.apply_filters(DY.daily(spark, path), FL.FilterSpec(date_range=("2024-01-08", "2024-01-21")))))
    places = re.findall(r"Location: \w+\s*(?:\(\d+ paths\))?\[([^\]]*)", p)
    assert places and all(path.rsplit("/", 1)[-1] in x for x in places) and "enriched" not in p
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", p)


def test_days_are_added_by_themselves(spark, scratch):
    day = lambda d: dt.date(2024, 1, d) if d else None
    frame = lambda *r: spark.createDataFrame([(e, n, day(d)) for e, n, d in r],
                                             "entity_id string, event_name string, event_date date")
    first = [("a", "job_visit", 1), ("a", "job_visit", 1), (None, "job_visit", 2), ("b", "job_apply_start", None)]
    m = DY.add_days(frame(*first), scratch)
    assert DY.stored_days(spark, scratch) == {"2024-01-01", "2024-01-02", ""}
    more = [*first, ("a", "job_visit", 1), ("c", "job_visit", 3), ("b", "job_visit", None)]
    n = DY.add_days(frame(*more), scratch)  # days that are there stay as they are
    assert n.version > m.version
    want = [("a", "job_visit", day(1), 2), (None, "job_visit", day(2), 1), ("b", "job_apply_start", None, 1), ("c", "job_visit", day(3), 1)]
    cols = ["entity_id", "event_name", "event_date", M.EVENTS]
    assert rows(DY.daily(spark, scratch).select(*cols)) == sorted(want, key=str)
    DY.add_days(frame(*more).where("event_date <> date'2024-01-02'"), scratch, days=["2024-01-01", day(2)])
    want = [("a", "job_visit", day(1), 3), ("b", "job_apply_start", None, 1), ("c", "job_visit", day(3), 1)]
    assert rows(DY.daily(spark, scratch).select(*cols)) == sorted(want, key=str)


# -- buckets ----------------------------------------------------------------------------------------------

@pytest.fixture()
def no_broadcast(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def test_bucketed_tables_are_not_shuffled(spark, no_broadcast):
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 60 + [f"v{i}" for i in range(60)] + [None]), rng.choice(["job_visit", "job_apply_start", "x"]),
             f"202401{rng.randint(1, 28):02}") for _ in range(3000)]
    events = spark.createDataFrame(data, "entity_id string, event_name string, event_date string")
    meta = spark.createDataFrame([(k, f"title {k}") for k in ["hot", "none", *[f"v{i}" for i in range(0, 60, 2)]]],
                                 "entity_id string, title string")
    tag = f"t{rng.getrandbits(60):x}"
    e = BK.write_bucketed(events, f"events_{tag}", "entity_id", ["event_date"], 8)
    m = BK.write_bucketed(meta, f"meta_{tag}", "entity_id", [], 8, split_hot=False)
    assert e.hot_keys == ["hot"] and e.rest.where("entity_id = 'hot' or entity_id is null").isEmpty()
    assert BK.open_bucketed(spark, f"events_{tag}", "entity_id").hot_keys == ["hot"]
    assert rows(BK.vacancy_counts(e)) == rows(M.vacancy_counts(events))
    assert rows(BK.join_metadata(e, m)) == rows(J.join_metadata(events, meta, order=False))
    counts = plan(M.vacancy_counts(e.rest))
    assert "Exchange" not in counts and "Bucketed: true" in counts
    joined = plan(J.join_metadata(e.rest, m.rest, order=False))
    assert "Exchange" not in joined and "SortMergeJoin" in joined
    assert "Exchange" in plan(M.vacancy_counts(events))


# -- addresses ------------------------------------------------------------------------------------------------

def test_addresses_are_parsed_once(spark, scratch, monkeypatch):
    some = ["1 High St, Leicester LE1 5YA", "Paris, , FR | Wales, Cardiff, GB", "Nowhere", "", None, " ", "SW1A 1AA", "England, Leeds, GB"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(some * 5)], "i int, regions string")
    want = rows(df.withColumn("uk_region", region_from_address("regions")))
    assert rows(AD.add_region_column(df, path=scratch)) == want
    assert AD.learn_addresses(df, "regions", scratch) == 0  # the second time none is parsed
    more = df.union(spark.createDataFrame([(99, "Kirkstall LS5 3BT")], df.schema))
    assert AD.learn_addresses(more, "regions", scratch) == 1
    out = AD.add_region_column(more, path=scratch)
    assert "RLIKE" not in plan(out).upper() and out.where("i = 99").first().uk_region == \
        more.withColumn("r", region_from_address("regions")).where("i = 99").first().r
    listed = df.withColumnRenamed("regions", "location_full")
    assert rows(AD.add_region_column(listed, path=scratch)) == rows(
        listed.withColumn("uk_region", region_from_locations("location_full")))
    assert AD.learn_addresses(df, "regions", scratch, postcode_mode="area") == 6  # other rules, other entries
    none = AD.add_region_column(df.select("i"), path=scratch)
    assert {r.uk_region for r in none.collect()} == {"Unknown"}
    empty = AD.regions_by_dictionary(df.where("regions is null"), "regions", path=scratch + "-none")
    assert {r.uk_region for r in empty.collect()} == {"Unknown"}


def test_two_writers_extend_the_dictionary(spark, scratch, monkeypatch):
    df = spark.createDataFrame([("Leeds LS1",), ("York",)], "regions string")
    AD.learn_addresses(df.where("regions = 'York'"), "regions", scratch)
    real, calls = PB.append, []

    def meanwhile(rows, path, base=None, **options):
        if not calls:
            calls.append(1)
            other = spark.createDataFrame([("Leeds LS1",), ("Bath",)], "regions string")
            assert AD.learn_addresses(other, "regions", scratch) == 2
        return real(rows, path, base=base, **options)
    monkeypatch.setattr(PB, "append", meanwhile)
    assert AD.learn_addresses(df, "regions", scratch) == 0
    table = PB.open_table(spark, scratch)
    assert table.count() == 3 == table.select("digest").distinct().count()


def test_legacy_frame_parses_no_event(spark, scratch):
    raw = legacy_events(spark, SF_SMALL)
    out = reports.load_legacy_frame(spark, raw, "2024-01-31", addresses=scratch)
    assert "RLIKE" not in plan(out).upper()
    want = raw.where("event_date >= '20231102'").withColumn("r", region_from_address("regions")).groupBy("r").count()
    assert rows(out.groupBy("uk_region").count()) == rows(want)
