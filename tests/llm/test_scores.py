"""Toxicity, language model and fertility rules."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from llm.conftest_llm import LOWER, SF, odd_rows, words_of
from pyspark.sql import functions as F

from vacancy_spark.llm import fertility, pitman_yor, toxicity

MID = "/root/testdata/sf0.1"


def test_machine_learns_pairs():
    """Two words are toxic together and neither alone: beyond any sum of weights."""
    rng = random.Random(1)
    filler = ["tree", "house", "river", "cloud", "stone", "bread"]
    def text(a, b):
        words = rng.choices(filler, k=6) + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        return " ".join(words).encode()
    cases = [(a, b) for a in (0, 1) for b in (0, 1)] * 150
    rows, labels = [], []
    for a, b in cases:
        _, _, term, x = toxicity.terms([text(a, b)])
        rows.append((term, x))
        labels.append(float(a and b))
    m = toxicity.Machine.learn(rows, np.array(labels, np.float32), epochs=20)
    for a, b in cases[:4]:
        assert (m.scores([text(a, b)])[0] > 0.5) == bool(a and b)
    long = b"tree house " * 3000
    assert m.scores([long + b" insult group"])[0] > m.scores([long])[0]


def test_toxicity_of_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    rows = toxicity.op2_toxicity(spark, MID).collect()
    assert len(rows) == spark.read.parquet(f"{MID}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    yes, no = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum(a > b for a in yes for b in no) / (len(yes) * len(no)) > 0.93
    assert sum(s >= 0.5 for s in no) <= 0.02 * len(no)


def test_driver_keeps_the_machine_alone_after_training(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    docs = [(i, " ".join("".join(rng.choices("abcdefgh", k=3)) for _ in range(500))) for i in range(400)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    learn, given, held = toxicity.Machine.learn, [], []
    monkeypatch.setattr(toxicity.Machine, "learn", lambda rows, label: given.extend(
        (t.tolist(), x.tolist(), float(y)) for (t, x), y in zip(rows, label)) or learn(rows, label))
    monkeypatch.setattr(toxicity, "hand_back", lambda: held.append(pa.total_allocated_bytes()))
    before = pa.total_allocated_bytes()
    toxicity.train(docs, labels, F.lit(True))
    assert len(held) == 1 and held[0] <= before + 1000
    want = []  # the weights that the executors no longer send
    for r in docs.collect():
        owner, segment, term, x = toxicity.terms([r.text.encode()])
        want += [(term[segment == k].tolist(), x[segment == k].tolist(), r.doc_id % 2) for k in range(len(owner))]
    assert sorted(given) == sorted(want)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 1), (5, 0), (None, 1), (9, None), (10, 0), (99, 1)],
                                   "doc_id long, toxic int")
    m = toxicity.train(odd, labels, F.lit(True))
    boxed = odd.select("text", F.struct("*").alias("row"))
    rows = toxicity.score(boxed, m).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.row.text or "", set()).add(r.score)
    assert all(len(x) == 1 for x in by.values())  # a score depends on the text alone
    assert toxicity.score(none.select("text", "doc_id"), m).count() == 0
    clash = toxicity.score(odd.withColumn("score", F.lit(7.0)), m)  # a column of that name is replaced
    assert clash.columns.count("score") == 1 and clash.where("score > 1").count() == 0
    empty = toxicity.train(odd, labels.where("false"), F.lit(True))
    assert max(empty.scores([b"anything", b""])) < 0.01


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def check_model(rows, texts):
    """The counted columns exactly; rows of one (id, text) are alike."""
    tokens = [(i, [*words_of((t or "").translate(LOWER)), None]) for i, t in texts]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(
        math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))
                   for r in rows) == want


def test_language_model(spark, odd, none):
    rule = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    check_model(pitman_yor.score(odd, rule, chunk_tokens=300, bucket_bytes=2000).collect(),
                [(i, t) for i, t, *_ in odd_rows()])
    assert pitman_yor.score(none, rule).count() == 0
    uniform = pitman_yor.score(odd, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.score < 1e-9 for r in uniform)
    rows = pitman_yor.op6_pitman_yor(spark, SF).collect()
    check_model(rows, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    again = pitman_yor.op6_pitman_yor(spark, SF).collect()
    assert sorted(again) == sorted(rows)


def test_model_probabilities_sum_to_one():
    """Over the known words and the unknown one, in every restaurant."""
    rng = np.random.default_rng(0)
    words = 40
    pairs = np.unique(rng.integers(0, words * 3, 90))
    word, context = pairs // 3, pairs % 3
    count = rng.integers(1, 200, len(pairs))
    full = lambda x: np.bincount(context, x, pitman_yor.CONTEXTS)
    known = len(np.unique(word))
    word = np.unique(word, return_inverse=True)[1]
    g = pitman_yor._Totals(full(count), full(np.ones(len(count))), known * 1.0, known, count.sum(), (0.6, 0.6))
    def seated(g, sweeps, keep, seed):
        return pitman_yor._sample(word, context, count, known, g, np.random.default_rng(seed), sweeps, keep)

    def totals(found):
        return pitman_yor._Totals(full(count), found[2], found[3], known, count.sum(), (0.6, 0.6))

    for n in range(pitman_yor.EPOCHS):  # one bucket: the totals it leaves are all there is
        g = totals(seated(g, pitman_yor.BURN_IN, 1, n))
    own, mean, _, _ = found = seated(g, 8, 4, 99)
    g = totals(found)
    mean = pitman_yor._parent(mean, g)
    unknown = pitman_yor._parent(np.zeros(1), g)[0]
    assert mean.min() > unknown > 0 and abs(mean.sum() + unknown - 1) < 1e-9
    s1, d1 = pitman_yor.STRENGTH[0], g.discounts[0]
    for k in range(3):
        p = own[context == k].sum() + (s1 + d1 * g.tables[k]) * (mean.sum() + unknown)
        assert abs(p / (s1 + g.customers[k]) - 1) < 1e-9


def test_model_has_a_restaurant_for_each_word(spark):
    """3000 words that each decide the next one: hashed into few restaurants they would not."""
    rng = random.Random(5)
    def text():
        return " ".join(f"a{i} b{i}" for i in rng.choices(range(3000), k=60))
    docs = spark.createDataFrame([(i, text()) for i in range(700)], "doc_id long, text string")
    rule = F.col("doc_id") % 10 == 0
    found = {}
    for size in (1 << 30, 30_000):  # one bucket; many, with the end sign's pairs dealt over several
        rows = pitman_yor.score(docs, rule, chunk_tokens=9000, bucket_bytes=size).collect()
        out = [r for r in rows if r.held_out]
        found[size] = sum(r.score for r in out) / sum(r.n_tokens for r in out)
        # half of the tokens are one of 3000 (3.48 each), the other half follow from the word before
        assert found[size] > -2.5
        assert sum(r.base_score for r in out) / sum(r.n_tokens for r in out) < -3.4
    assert abs(found[1 << 30] - found[30_000]) < 0.02


def test_model_deals_hot_words(spark):
    """A word of a third of the tokens in several buckets: its counts and the model stay the same."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(400)} x{rng.randrange(400)} the" for _ in range(40)))
            for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    total = sum(len(t) for _, t in rows)
    hot = pitman_yor._hot_words(docs, total, 12)
    assert max(hot.values()) >= 4
    one, many = (sorted(pitman_yor.score(docs, F.col("doc_id") % 10 == 0, chunk_tokens=3000,
                                         bucket_bytes=b).collect()) for b in (1 << 30, total // 12))
    assert [tuple(r)[:5] for r in one] == [tuple(r)[:5] for r in many]
    tokens = sum(r.n_tokens for r in one)
    assert abs(sum(a.score - b.score for a, b in zip(one, many))) / tokens < 0.01


def plain(text):
    words = words_of(text)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if words_of(x):
            dup += x in seen
            seen.add(x)
    at = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if at[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), failed)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_fertility(spark, odd, none, sf_docs):
    rows = fertility.judge(odd).collect()
    assert Counter((r.doc_id, *(r[c] for c in NAMES)) for r in rows) == Counter(
        (i, *plain(t)) for i, t, *_ in odd_rows())
    assert not any(r.kept and r.base_failed for r in rows)
    assert fertility.judge(none).count() == 0
    rows = fertility.op7_fertility_rules(spark, SF).collect()
    assert Counter((r.doc_id, *(r[c] for c in NAMES)) for r in rows) == Counter(
        (r.doc_id, *plain(r.text)) for r in sf_docs.collect())


def test_fertility_measures_and_verdict(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=fertility.vocabulary_path(fertility.VOCABULARY))
    text = "the quick brown 中文 fox é jumps 龘 over the the lazy dog"
    found = fertility.measure([text.encode(), b""], fertility._Vocabulary(
        fertility.vocabulary_path(fertility.VOCABULARY)))
    ids = [i for w in words_of(text) for i in lib.encode(w)]
    share = np.array(list(Counter(ids).values())) / len(ids)
    assert found["n_tokens"].tolist() == [len(ids), 0]
    assert math.isclose(found["entropy"][0], -(share * np.log2(share)).sum())
    assert math.isclose(found["byte_share"][0], np.mean([lib.is_byte(i) for i in ids]))
    assert math.isclose(found["chars_per_token"][0], sum(map(len, words_of(text))) / len(ids))

    docs = spark.read.parquet(f"{MID}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    rows = [r for r in fertility.judge(docs).collect() if r.doc_id in quality and not r.base_failed]
    good = [r.kept for r in rows if quality[r.doc_id]]
    bad = [r.kept for r in rows if not quality[r.doc_id]]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.5


def test_fertility_keeps_small_groups(spark):
    """No language and octave loses its good documents; a language too small for a band keeps all."""
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    groups = {}
    for r in fertility.judge(docs).collect():
        if quality.get(r.doc_id) and not r.base_failed:
            groups.setdefault((r.lang, int(math.log2(max(r.n_tokens, 1)))), []).append(r.kept)
    lost = {k: (sum(v), len(v)) for k, v in groups.items() if np.mean(v) < 0.9 and len(v) - sum(v) > 1}
    assert not lost
    few = docs.limit(60).withColumn("lang", F.lit("xx"))
    assert all(r.kept or r.base_failed for r in fertility.judge(docs.unionByName(few)).where("lang = 'xx'").collect())
