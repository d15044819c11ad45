"""Spectrum slicing against a library's eigenvectors, whitening against its definition."""

import math

import numpy as np
import pytest
from llm.conftest_llm import SF
from pyspark.sql import functions as F

from vacancy_spark.llm import whitening as W


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    v = q * np.array(values, float) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1, 0.5], [1], [2, 1], [1e6, 1, 1e-3, 1e-6, 0, 0], [3, 3 - 1e-9, 3 - 2e-9, 1, 1, 1],
    [7, 7, 7, 2, 2, 1], [1] * 5, [0] * 4, [4, 3, 3, 3, 3, 3, 3], list(range(40, 0, -1)),
    [1 + 1 / 2**i for i in range(30)], [1, 1e-9, 0]])
def test_leading_components(values):
    v = spectrum(values)
    got, vectors = W.leading(v, 4)
    k = min(4, len(values))
    want = np.sort(np.linalg.eigvalsh(v))[::-1][:k]
    size = max(1e-300, np.abs(want).max())
    assert np.abs(got - want).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(v @ vectors - vectors * got).max() <= 1e-12 * size


def test_counts_of_pivots():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 20):
        for _ in range(40):
            a = rng.standard_normal((n, n)) * rng.choice([1, 0], (n, n), p=[.6, .4])
            a = a + a.T
            e = np.linalg.eigvalsh(a)
            for s in rng.uniform(-3, 3, 5):
                if np.abs(e - s).min() > 1e-9:
                    assert W.positive_pivots(a, s) == (e > s).sum()


def test_exact_products():
    rng = np.random.default_rng(4)
    for most in (3, 2**19, 2**30, 2**45, 2**60):
        y = rng.integers(-most, most, (50, 3))
        assert (W._exact_product(y).astype(object) == y.astype(object).T @ y.astype(object)).all()


def plain(rows, k=4, scale=256):
    """The contract, for vectors of one length: (id, component) -> values, whitened without sign."""
    good = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fitted = np.array(sorted({tuple(x) for _, x in good}), float)
    n, total = len(fitted), [sum(int(a) for a in c) for c in fitted.T]
    y = fitted - fitted.mean(0)
    cov = y.T @ y / n
    e, p = np.linalg.eigh(cov)
    e, p = e[::-1][:k], p[:, ::-1][:, :k]
    out = []
    for i, x in good:
        w = (np.array(x) - fitted.mean(0)) @ p
        dev = sum((n * a - s)**2 for a, s in zip(x, total))
        for c in range(min(k, len(e))):
            some = e[c] > 1e-12 * np.trace(cov)
            out.append((i, c + 1, n, dev, abs(w[c]) / e[c]**.5 if some else None, e[c] / max(np.trace(cov), 1e-300)))
    return out


def check(got, want):
    key = lambda r: (str(r[0]), r[1], r[3], r[4] is None, abs(r[4] or 0))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want):
        assert (g[4] is None) == (w[4] is None)
        assert g[4] is None or abs(abs(g[4]) - w[4]) < 1e-7 * max(1, w[4])
        assert abs(g[5] - w[5]) < 1e-9 and 0 <= g[6] < 1e-9


def test_driver_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = W.op11_spectrum_whitening(spark, SF).collect()
    check(got, plain(rows))
    signs = {}
    for r in got:  # one sign for all rows: whitened columns are uncorrelated over distinct vectors
        signs.setdefault(r.component, {})[r.vec_id] = r.whitened
    a, b = (np.array(list(signs[c].values())) for c in (1, 2))
    assert abs((a * b).mean()) < .05


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(40)]
    rows += [(1, rows[0][1]), (None, rows[5][1]), (99, None), (98, [nan] + [0.] * 5), (97, [inf] + [0.] * 5),
             (96, [None] + [0.] * 5), (95, [-0.0] * 6), (94, [0.0] * 6), (95, [-0.0] * 6)]
    extra = [(i, v, float(i or 0), "x") for i, v in rows]
    df = spark.createDataFrame(extra, "vec_id long, embedding array<float>, whitened double, x string")
    as_float = [(i, v and [c if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    check(W.whiten(df).collect(), plain(as_float))
    other = [(200, [1.0, 2.0]), (201, [3.0, -1.0]), (202, [1.0, 2.0]), (203, []), (204, [1e300, 0.0])]
    both = df.select("vec_id", "embedding").union(spark.createDataFrame(other, "vec_id long, embedding array<double>"))
    check(W.whiten(both).collect(), plain(as_float) + plain(other[:3]))
    alike = spark.createDataFrame([(1, [2.0, 3.0, 4.0]), (2, [2.0, 3.0, 4.0])], "vec_id long, embedding array<double>")
    got = W.whiten(alike).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened) for r in sorted(got)] == [
        (i, c, 1, 0, None) for i in (1, 2) for c in (1, 2, 3)]
    assert W.whiten(df.where("false")).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(i) * 1e9 + .25, -float(i * i) * 1e7, 1e12]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x)]
    want = {i: sum((5 * a - s)**2 for a, s in zip(v, total)) for i, v in enumerate(x)}
    for r in W.whiten(df).collect():
        assert r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None)
    assert W.distinct_vectors(df.union(df)).count() == 5
    assert W.fit(W.distinct_vectors(df.withColumn("embedding", F.col("embedding"))))[3].n == 5
