"""Spark results against plain-Python computations on generated frames in which one vacancy
holds a third or more of all events (the hot-key case)."""

import datetime as dt
import random
import statistics

import pytest

from vacancy_spark.operators import metrics as M
from vacancy_spark.operators import vacancy as V

SCHEMA = "entity_id string, event_date date, event_name string, uk_region string"
NAMES = ["job_visit", "job_visit", "job_apply_start", "other"]


def make_rows(seed: int, n: int = 600):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0  # a third of the rows belong to one vacancy
        ent = "hot" if hot else f"v{rnd.randrange(40)}"
        region = None if rnd.random() < 0.1 else rnd.choice(["North", "South", "East"])
        if hot:
            region = "North"
        rows.append((ent, dt.date(2024, 1, 1 + rnd.randrange(20)), rnd.choice(NAMES), region))
    return rows


def per_vacancy(rows):
    out = {}
    for ent, _d, name, _r in rows:
        c, a = out.get(ent, (0, 0))
        out[ent] = (c + (name == "job_visit"), a + (name == "job_apply_start"))
    return out


def quantile(values, q):
    s = sorted(values)
    pos = (len(s) - 1) * q
    lo = int(pos)
    hi = min(lo + 1, len(s) - 1)
    return s[lo] + (s[hi] - s[lo]) * (pos - lo)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_kpi_and_benchmark(spark, seed):
    rows = make_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    pv = per_vacancy(rows)
    k = M.kpi_metrics(df).first()
    clicks = sum(c for c, _ in pv.values())
    applies = sum(a for _, a in pv.values())
    assert k["num_vacancies"] == len(pv)
    assert k["total_clicks"] == clicks and k["total_applies"] == applies
    assert k["median_clicks_per_vacancy"] == statistics.median([c for c, _ in pv.values()])
    assert k["mean_clicks_per_vacancy"] == pytest.approx(clicks / len(pv))

    bench = {r["uk_region"]: r for r in M.benchmark(df, "uk_region").collect()}
    for region in ("North", "South", "East"):
        sub = [r for r in rows if r[3] == region]
        spv = per_vacancy(sub)
        b = bench[region]
        assert b["vacancies"] == len(spv)
        assert b["total_clicks"] == sum(c for c, _ in spv.values())
        assert b["median_clicks_per_vac"] == pytest.approx(
            round(statistics.median([c for c, _ in spv.values()]), 1))
    assert bench[None]["vacancies"] == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_quartiles(spark, seed):
    rows = make_rows(seed)
    pv = per_vacancy(rows)
    vals = [c for c, _ in pv.values()]
    q1, q3 = quantile(vals, 0.25), quantile(vals, 0.75)
    want = {
        "top_25": [e for e, (c, _) in pv.items() if c >= q3],
        "middle_50": [e for e, (c, _) in pv.items() if q1 <= c < q3],
        "bottom_25": [e for e, (c, _) in pv.items() if c < q1],
    }
    got = {r["quartile"]: r for r in M.quartile_metrics(spark.createDataFrame(rows, SCHEMA)).collect()}
    for name, ents in want.items():
        assert got[name]["num_vacancies"] == len(ents)
        assert got[name]["total_clicks"] == sum(pv[e][0] for e in ents)
        assert got[name]["total_applies"] == sum(pv[e][1] for e in ents)


def test_vacancy_report_hot_key(spark):
    rows = make_rows(6)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "'t' AS title", "'o' AS organization_name", "'published' AS workflow_state",
        "CAST(NULL AS TIMESTAMP_NTZ) AS start_date", "CAST(NULL AS TIMESTAMP_NTZ) AS end_date",
        "'occ' AS occupation", "'imp' AS importer_name", "CAST(array() AS ARRAY<STRING>) AS upgrades_list")
    rep = {r["job_id"]: r for r in V.vacancy_report(df, "2024-01-31").collect()}
    pv = per_vacancy(rows)
    assert set(rep) == set(pv)
    for e, (c, a) in pv.items():
        assert (rep[e]["clicks"], rep[e]["applies"]) == (c, a)
        want = round(a / c * 100, 2) if c else None
        assert rep[e]["ratio_pct"] == (pytest.approx(want) if want is not None else None)


def test_dedup_latest_hot_key(spark):
    from vacancy_spark.operators.clean import dedup_latest
    rnd = random.Random(9)
    rows = [("hot" if i % 3 == 0 else f"k{rnd.randrange(50)}", rnd.randrange(1000), f"v{i}")
            for i in range(900)]
    got = {r["k"]: (r["ts"], r["v"]) for r in
           dedup_latest(spark.createDataFrame(rows, "k string, ts int, v string"), "k", ["ts", "v"]).collect()}
    want = {}
    for k, ts, v in rows:
        if k not in want or (ts, v) > want[k]:
            want[k] = (ts, v)
    assert got == want
