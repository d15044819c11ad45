"""Mixing and top-k search against plain versions; both also have SQL."""

import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from llm.conftest_llm import SF, odd_rows, words_of
from pyspark.sql import functions as F

from vacancy_spark.llm import mixing, registry, topk


def plain_mix(rows):
    size = [len(words_of(t)) for _, t, _ in rows]
    sources = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        sources[s] += n
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size)
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= 2 * sources[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sources[s]
            free.remove(s)
            left -= target[s]
        if not free:
            break
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    u = lambda i: (int(hashlib.md5(f"{'null' if i is None else i}:mix".encode()).hexdigest()[:13], 16) + .5) / 2**52
    out = Counter()
    for s in order:
        whole = math.floor(target[s] / sources[s]) if sources[s] else 0
        need = target[s] - whole * sources[s]
        mine = [(u(i), -1 if i is None else i, n, i) for (i, _, x), n in zip(rows, size) if x == s]
        at = 0
        for _, _, n, i in sorted(mine):
            extra = bool(sources[s]) and target[s] / sources[s] > whole and at + n / 2 <= need
            out[i, n, sources[s], round(target[s], 6), n * (whole + extra)] += 1
            at += n
    return out


def got(df):
    return Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def test_mixing(spark, odd, none, sf_docs):
    assert got(mixing.mix(odd)) == plain_mix([(i, t, s) for i, t, _, s, *_ in odd_rows()])
    assert mixing.mix(none).count() == 0
    rows = [(r.doc_id, r.text, r.source) for r in sf_docs.collect()]
    found = got(mixing.op1_pareto_mixing(spark, SF))
    assert found == plain_mix(rows) == got(mixing.op1_pareto_mixing(spark, SF))
    carried = mixing.mix(odd, keep=("row",)).columns
    assert carried[-1] == "row"


def test_mixing_is_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in (mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"),
                                                     F.max("size").alias("most")).collect()):
        assert abs(r.taken - r.target) <= r.most / 2 + 1


def plain_top(rows, k=10):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for i, q in rows:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best[:k])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"row_block": 7, "query_block": 2}])
def test_top_k(spark, options):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(0, 900, 9)]
    rows += [(100, [1.0, 0.5, None, 0.0]), (200, None), (None, [1.0] * 4), (300, [math.nan] * 4),
             (400, [1.0, math.inf, 0.0, 0.0]), (500, [1.0] * 3), (501, [2.0] * 3), (600, []), (601, []),
             (700, [1.0] * 4), (703, [1.0] * 4), (703, [1.0] * 4), (800, [1e12] * 4)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows],
                               "vec_id long, embedding array<double>, rows string, score double")
    found = topk.top_k(df, F.col("vec_id") % 100 == 0, **options).collect()
    assert sorted(map(tuple, found)) == plain_top(rows)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_search_stops_early():
    """Lists whose heads decide are not read to the end, and the result is still exact."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = np.floor(rng.exponential(1, (4000, 3)) ** 4)
    ids = np.arange(4000)
    q = np.array([[3.0, 2.0, 1.0], [-1.0, 0.0, 2.0]])
    which, where, score = topk.threshold_top_k(rows, ids, q, np.array([-1, 17]), 5)
    for k in range(2):
        full = rows @ q[k]
        full[ids == [-1, 17][k]] = -np.inf
        assert where[which == k].tolist() == np.lexsort((ids, -full))[:5].tolist()


@pytest.mark.parametrize("key", sorted(registry.ORACLE))
def test_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        assert os.path.exists(f"{SF}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[key](spark, SF)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLE[key]})").fetchall()
    assert sorted(map(tuple, df.select(names).collect())) == sorted(want)
