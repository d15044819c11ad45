"""Removed bytes against counting every string of the length."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm.conftest_llm import SF, odd_rows

from vacancy_spark.llm import suffix_dedup as S


def brute(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_merged_transforms_find_the_repeats():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.choice([5, 8, 20, 40])
        base = bytes(rng.choices(b"ab", k=rng.randint(0, 60)))
        texts = [bytes(rng.choices(b"abc", k=rng.randint(0, 30))) + base[rng.randint(0, 20):]
                 + bytes(rng.choices(b"ab\0", k=rng.randint(0, 20))) for _ in range(rng.randint(1, 8))]
        doc, _, _, start, strings = S.pieces(texts, n)
        places = sorted((d, x) for d, a, k in zip(doc, start, strings) for x in range(a, a + k))
        assert places == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - n + 1)]
        dealt = [x for x in (list(range(len(texts)))[i::3] for i in range(3)) if x]
        shards = [(*S.transform([texts[i] for i in x]), np.array([len(texts[i]) for i in x])) for x in dealt]
        order = [i for x in dealt for i in x]
        string, offset = S.merged_repeats(shards, n)
        seen = Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
        assert {(order[s], o) for s, o in zip(string, offset)} == {
            (d, i) for d, t in enumerate(texts) for i in range(len(t) - n + 1) if seen[t[i:i + n]] > 1}


def check(df, rows, length):
    want = Counter((i, *x) for (i, _), x in zip(rows, brute([(t or "").encode() for _, t in rows], length)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
                   for r in df.collect()) == want


@pytest.mark.parametrize("options", [{}, {"crowd": 1, "task_pieces": 5}])
def test_odd_rows(spark, odd, none, options):
    """Also with every mixed gram counted string by string."""
    rows = [(i, t) for i, t, *_ in odd_rows()]
    for length in (40, 200):
        check(S.remove_repeats(odd.select("doc_id", "text", "size", "label"), length, **options), rows, length)
    names = spark.createDataFrame([(1, "x" * 500, "own", 7)], "doc_id long, text string, kept string, n_bytes int")
    clash = S.remove_repeats(names)  # columns named like the results are replaced
    assert clash.columns == ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
    assert clash.first().n_bytes == 500
    out = S.remove_repeats(none, with_text=True)
    assert out.count() == 0 and set(none.columns) - {"text"} <= set(out.columns)


def test_shared_passages(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcde fgh", k=n))
    passages = [text(rng.randint(150, 600)) for _ in range(6)]
    rows = [(i, text(rng.randint(0, 300)) + "".join(rng.choices(passages, k=rng.randint(0, 3)))
             + text(rng.randint(0, 300))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(S.remove_repeats(df, task_pieces=20), rows, 200)
    check(S.remove_repeats(df, crowd=3), rows, 200)


def test_driver_documents(spark, sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    want = {(i, *x) for (i, _), x in zip(rows, brute([t.encode() for _, t in rows], 200))}
    assert set(map(tuple, S.op8_suffix_dedup(spark, SF).collect())) == want
