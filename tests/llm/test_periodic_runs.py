"""Runs of words against their definition, tried for every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from llm.conftest_llm import SF, odd_rows, words_of

from vacancy_spark.llm import periodic_runs as P


def brute(words, least=24, times=3):
    """(start, length, period) of every longest stretch, its smallest period only."""
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def arranged(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digests(doc_id, text):
    words = arranged(doc_id, words_of(text))
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_extensions_agree_with_comparing():
    rng = random.Random(5)
    for _ in range(200):
        base = rng.choices(range(rng.choice([1, 2, 5])), k=rng.randint(1, 40))
        text = [x for _ in range(rng.randint(1, 6)) for x in
                (base * rng.randint(1, 4) if rng.random() < .6 else [7] * rng.randint(1, 60))]
        text = np.array([90, *text, 91])
        levels = P.grammar(text)
        a, b = np.array([(i, j) for i in range(1, len(text)) for j in range(i + 1, len(text))][:3000]).T
        far = P.extensions(levels, a, b)
        back = P.extensions([x.reversed() for x in levels], len(text) - a, len(text) - b)
        for i, j, x, y in zip(a, b, far, back):
            k = 0
            while j + k < len(text) and text[i + k] == text[j + k]:
                k += 1
            m = 0
            while text[i - m - 1] == text[j - m - 1] and i - m - 1 > 0:
                m += 1
            assert (x, y) == (k, m)


def test_runs_of_many_texts():
    rng = random.Random(6)
    for least, times in ((24, 3), (6, 3), (4, 2), (1, 2)):
        for _ in range(60):
            texts = []
            for _ in range(rng.randint(0, 8)):
                t = []
                for _ in range(rng.randint(0, 6)):
                    unit = rng.choices(range(rng.choice([1, 2, 3, 50])), k=rng.randint(1, 9))
                    t += unit * rng.choice([1, 1, 2, 5, 12]) + unit[:rng.randint(0, len(unit))]
                texts.append(t)
            words = np.array([x for t in texts for x in t], np.int64)
            got = P.runs_of(words, np.array([len(t) for t in texts], np.int64), least, times)
            assert got.tolist() == [[d, *r] for d, t in enumerate(texts) for r in brute(t, least, times)]


def test_small_grid_blocks(monkeypatch):
    monkeypatch.setattr(P, "GRID_ROWS", 50)
    unit = list(range(40))
    words = np.array([100, 101, *unit * 4, 102, *[3] * 30])
    got = P.runs_of(words, np.array([len(words)]))
    assert got.tolist() == [[0, 2, 160, 40], [0, 163, 30, 1]]


def test_odd_rows(spark, odd, none):
    extra = [(100, "a b c " * 30, 7), (101, "w " * 5000, 7), (None, "x y " * 20, 7), (102, "    " * 30, 7)]
    rows = [(i, t, None) for i, t, *_ in odd_rows()] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = P.periodic_runs(df).collect()
    assert len(got) == len(rows)
    by = sorted(((r.doc_id is None, r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str)
    want = []
    for i, t, _ in rows:
        w = words_of(t)
        runs = brute(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i is None, i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert by == sorted(want, key=str)
    assert P.periodic_runs(none).count() == 0


def test_driver_documents(spark, sf_docs):
    got = sorted(map(tuple, P.op12_periodic_runs(spark, SF).collect()))
    want = sorted(digests(r.doc_id, r.text) for r in sf_docs.collect())
    assert got == want
    assert sum(r[1] > 0 for r in want) >= len(want) // 20
