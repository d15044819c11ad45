"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (lower-cased over A-Z, cut at white space and ASCII punctuation) and
the first bytes of longer words, hashed into a table of fixed size. Besides a weight, each term
has a short vector; the product of two terms' vectors is the weight of the two appearing together,
so an insult next to a mention of a group can count for more than the sum of both. A text is
scored in segments of bounded length and takes the highest score, so that a long text isn't
cleared by its length.

Learned from at most ``TRAIN_ROWS`` labelled documents (the smallest hashes of their ids) and
twice as many of their segments, a documented bound of the fitted sample; the table's size bounds
what is sent to the executors.

Null and empty texts have no terms and get the score that the bias alone gives. Labels that are
null or belong to no document are not learned from; an id that several documents or labels share
gives a row each. Without both kinds of label every score is the share of toxic ones (0 without
labels). Extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancy_spark.llm._shared import documents, hand_back, narrow_batches, tidy
from vacancy_spark.llm._words import _SPACE, Words, batches_of, text_bytes

BITS = 18
FACTORS = 8
PREFIXES = (4, 6)
SEGMENT_WORDS = 400
TRAIN_ROWS = 10_000
EPOCHS = 8
SCALE = 5.0  # length of a segment's weights
DECAY = 1e-2
MIN_EXAMPLES = 4  # terms of fewer examples are not learned
BATCH_BYTES = 1 << 18  # of texts whose terms are found at once, in some 200 bytes for each

_BREAK = _SPACE.copy()
_BREAK[[i for i in range(128) if not chr(i).isalnum()]] = True


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each segment, segment, term, weight): the segments' distinct terms, each
    segment's weights being of length SCALE."""
    w = Words(texts, lower=True, space=_BREAK)
    place = np.arange(len(w.doc)) - w.first[:-1][w.doc]
    piece = place // SEGMENT_WORDS
    new = np.ones(len(w.doc), bool)
    new[1:] = (w.doc[1:] != w.doc[:-1]) | (piece[1:] != piece[:-1])
    segment = np.cumsum(new) - 1
    keys = [(segment, w.hash)]
    for n in PREFIXES:
        long = w.end - w.start > n
        keys.append((segment[long], w.span_hash(w.start[long], w.start[long] + n)
                     ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)))
    key = np.concatenate([(s << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64)
                          for s, h in keys]) if len(segment) else np.zeros(0, np.int64)
    key = np.unique(key)
    segment, term = key >> BITS, key & ((1 << BITS) - 1)
    weight = SCALE / np.sqrt(np.bincount(segment))[segment] if len(key) else np.zeros(0)
    return w.doc[new], segment, term, weight.astype(np.float32)


class Machine:
    """Bias, weights and vectors of a factorization machine for yes or no."""

    def __init__(self, bias: float = 0.0, weight: np.ndarray | None = None,
                 vector: np.ndarray | None = None):
        self.bias, self.weight, self.vector = bias, weight, vector

    def raw(self, starts: np.ndarray, term: np.ndarray, x: np.ndarray):
        """Log odds of rows of terms (``starts``: where each begins), and the rows' sums."""
        v = self.vector[term] * x[:, None]
        sums = np.add.reduceat(v, starts, axis=0)
        pairs = 0.5 * ((sums ** 2).sum(1) - np.add.reduceat((v * v).sum(1), starts))
        return self.bias + np.add.reduceat(self.weight[term] * x, starts) + pairs, sums, v

    @classmethod
    def learn(cls, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, seed: int = 0,
              epochs: int = EPOCHS, batch: int = 64, rate: float = 0.1, decay: float = DECAY,
              min_examples: int = MIN_EXAMPLES):
        """Adagrad on the log loss. ``rows``: terms and weights of each example."""
        random = np.random.default_rng(seed)
        size = 1 << BITS
        share = min(max(float(label.mean()) if len(label) else 0.0, 1e-6), 1 - 1e-6)
        m = cls(float(np.log(share / (1 - share))), np.zeros(size, np.float32),
                random.normal(0, 0.05, (size, FACTORS)).astype(np.float32))
        if not 0 < label.sum() < len(label):
            m.vector[:] = 0
            return m
        examples = np.bincount(np.concatenate([t for t, _ in rows]), minlength=size)
        learned = examples >= min_examples
        m.vector[~learned] = 0  # other terms must not count
        rows = [(t[k], x[k]) if (k := learned[t]).any() else (t[:1], x[:1] * 0) for t, x in rows]
        past_w, past_v, past_b = np.full(size, 1e-3, np.float32), np.full((size, FACTORS), 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            order = random.permutation(len(rows))
            for a in range(0, len(order), batch):
                pick = order[a:a + batch]
                term = np.concatenate([rows[i][0] for i in pick])
                x = np.concatenate([rows[i][1] for i in pick])
                n = np.array([len(rows[i][0]) for i in pick])
                starts = np.cumsum(n) - n
                z, sums, v = m.raw(starts, term, x)
                g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label[pick]).astype(np.float32)
                own = np.repeat(np.arange(len(pick)), n)
                kinds, place = np.unique(term, return_inverse=True)
                gw = np.bincount(place, g[own] * x).astype(np.float32) + decay * m.weight[kinds]
                each = (g[own] * x)[:, None] * (sums[own] - v)
                gv = np.empty((len(kinds), FACTORS), np.float32)
                for f in range(FACTORS):
                    gv[:, f] = np.bincount(place, each[:, f])
                gv += decay * m.vector[kinds]
                past_w[kinds] += gw ** 2
                past_v[kinds] += gv ** 2
                m.weight[kinds] -= rate * 5 * gw / np.sqrt(past_w[kinds])
                m.vector[kinds] -= rate * gv / np.sqrt(past_v[kinds])
                past_b += float(g.sum()) ** 2
                m.bias -= rate * float(g.sum()) / past_b ** 0.5
        return m

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Each text's highest segment score, between 0 and 1."""
        owner, segment, term, x = terms(texts)
        out = np.full(len(texts), self.bias)
        if len(owner):
            starts = np.searchsorted(segment, np.arange(len(owner)))
            z, _, _ = self.raw(starts, term, x)
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, owner, z)
            out = np.where(np.isfinite(best), best, out)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Machine:
    """A machine learned from the labelled documents for which ``learn`` (on the id) holds.

    The rows with the smallest hashes of their ids, at most ``train_rows``, are hashed into terms
    on the executors and learned from on the driver.
    """
    narrow_batches(docs.sparkSession)
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn)
             .select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")))
    sample = known.orderBy(F.xxhash64("id"), "label").limit(train_rows)  # bounded, so broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), "id")

    def hashed(batches):
        for b in batches:
            texts, label = text_bytes(b.column("text")), b.column("label").to_pylist()
            for part in batches_of([len(t) for t in texts], BATCH_BYTES):
                owner, segment, term, x = terms(texts[part])
                starts = np.searchsorted(segment, np.arange(len(owner) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label[part][d] for d in owner], pa.float64()),
                     pa.ListArray.from_arrays(pa.array(starts), pa.array(term, pa.int32()))],
                    ["label", "term"])

    found = rows.mapInArrow(tidy(hashed), "label double, term array<int>")
    # in an order that reruns share; a text of many segments has many rows
    machine = _learned(found.withColumn("order", F.xxhash64("term", "label")).orderBy("order").limit(
        2 * train_rows).select("label", "term"))
    hand_back()  # the driver's process goes on, without the examples
    return machine


def _learned(rows: DataFrame) -> Machine:
    """A machine learned on the driver from ``rows``: label, term (a segment's distinct terms)."""
    table = rows.toArrow().combine_chunks()
    lists = table.column("term").combine_chunks()
    cut = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
    term = np.split(lists.flatten().to_numpy(), cut[1:-1])
    # the terms of a segment weigh the same (see terms()), so their weights need not be sent
    x = [np.full(len(t), SCALE / np.sqrt(max(1, len(t))), np.float32) for t in term]
    return Machine.learn(list(zip(term, x))[:len(table)],
                         table.column("label").to_numpy().astype(np.float32))


def score(docs: DataFrame, machine: Machine, text_col: str = "text",
          name: str = "score") -> DataFrame:
    """``docs`` without its text column and with the column ``name`` (instead of one that it has of that
    name): each whole text's score."""
    spark = docs.sparkSession
    narrow_batches(spark)
    shared = spark.sparkContext.broadcast(
        (machine.bias, machine.weight, machine.vector))  # of fixed size

    rest = [c for c in docs.columns if c not in (text_col, name)]
    schema = docs.select(rest).withColumn(name, F.lit(0.0)).schema

    def run(batches):
        m = Machine(*shared.value)
        for b in batches:
            texts = text_bytes(b.column(len(rest)))
            found = [m.scores(texts[part])
                     for part in batches_of([len(t) for t in texts], BATCH_BYTES)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(rest))),
                 pa.array(np.concatenate(found) if found else [], pa.float64())], [*rest, name])

    return docs.select(*rest, text_col).mapInArrow(tidy(run), schema)


def _remainder(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % 5


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows whose id's crc32 is divisible by 5 are held out."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = train(docs, labels, _remainder(F.col("doc_id")) != 0)
    held = F.coalesce(_remainder(F.col("doc_id")) == 0, F.lit(False))
    return (score(docs.select("doc_id", "text", held.alias("held_out")), machine)
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
