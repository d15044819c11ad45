"""Quality rules by tokeniser fertility.

Each distinct word is encoded once by a public sentencepiece vocabulary with byte fallback. A
document's measures are its characters per token, the share of tokens that are fallback bytes,
and the entropy of its tokens. Documents outside the band of their language are rejected (of their
language and octave of token counts, except for the share of bytes: entropy grows with length,
and the characters per token of short documents vary more). A band lies
around the median, a number of robust deviations wide, both taken over all documents that the
plain rules pass. An octave of few documents takes the band of its language's nearest octave, made
wider for the distance; a language without any such octave has one band for all lengths. Another
language's band is never used: a language of few documents has none, and its documents pass.

The plain rules (too few words, too many words in repeated 8-word windows) come first: what they
fail is never kept. Null texts have no words and fail. A null language is one language of its
own. Repeated rows are judged alike; ids are only passed on. Extra columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacancy_spark.llm._encode import _ranges, vocabulary_path
from vacancy_spark.llm._shared import documents, narrow_batches, stored
from vacancy_spark.llm._words import Words, batches_of, text_bytes

VOCABULARY = "piece_bpe_32k.model"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WIDTH = 5.0  # half width of a band in robust standard deviations
MIN_DOCUMENTS = 100  # an octave or a language with fewer has no band of its own
STEP = 1 / 64  # measures are counted in steps of this width
BATCH_BYTES = 4 << 20
CACHE_WORDS = 300_000

MEASURES = ("chars_per_token", "byte_share", "entropy")
LEAST = (0.12, 0.05, 0.3)  # a band is at least so far from the median on either side
SCHEMA = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, "
          "n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, "
          "byte_share double, entropy double")


class _Vocabulary:
    """Token ids of words; a word's ids are kept under its hash."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        self.is_byte = np.array([self.lib.is_byte(i) for i in range(n)])
        self.empty()

    def empty(self) -> None:
        self.rows: dict[int, int] = {}
        self.ids = [np.zeros(0, np.int32)]
        self.lengths = [np.zeros(0, np.int64)]

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after the other, and each word's number of ids."""
        if len(self.rows) > CACHE_WORDS:
            self.empty()
        keys, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        new = [i for k, i in zip(keys.tolist(), first.tolist()) if k not in self.rows]
        if new:
            start, end, raw = w.start, w.end, w.data.tobytes()
            found = self.lib.encode([raw[start[i]:end[i]].decode() for i in new], num_threads=1)
            n = len(self.rows)
            self.rows.update((k, n + j) for j, k in enumerate(w.hash[new].tolist()))
            self.lengths = [np.concatenate([*self.lengths, [len(x) for x in found]])]
            self.ids.append(np.fromiter((t for x in found for t in x), np.int32))
            self.ids = [np.concatenate(self.ids)]
        row = np.fromiter(map(self.rows.__getitem__, keys.tolist()), np.int64, len(keys))[inverse]
        lengths = self.lengths[0].astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        return self.ids[0][_ranges(starts[row], lengths[row])], lengths[row]


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes], vocabulary: _Vocabulary) -> dict[str, np.ndarray]:
    """The plain counts and the measures of each text."""
    w, n = Words(texts), len(texts)
    per_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[w.bounds])
    chars = per_text(w.inside & ((w.data & 0xC0) != 0x80))
    symbols = per_text(np.isin(w.data, np.frombuffer(b"#*$%&|<>", np.uint8)))

    window, whole = w.windows(WINDOW)
    at = np.flatnonzero(whole)
    key = window[at] + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    repeated = np.bincount(w.doc, np.cumsum(cover[:-1]) > 0, n).astype(np.int64)

    ids, lengths = vocabulary.encode(w)
    owner = np.repeat(w.doc, lengths)
    tokens = np.bincount(owner, minlength=n)
    fallback = np.bincount(owner, vocabulary.is_byte[ids], n)
    kinds, counts = np.unique(owner * len(vocabulary.is_byte) + ids, return_counts=True)
    total = np.maximum(tokens, 1)
    who = kinds // len(vocabulary.is_byte)
    share = counts / total[who]
    entropy = np.bincount(who, -share * np.log2(share), n)
    return {"n_words": w.counts, "word_chars": chars, "n_symbols": symbols,
            "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64),
            "n_repeat_words": repeated, "n_tokens": tokens, "chars_per_token": chars / total,
            "byte_share": fallback / total, "entropy": entropy}


def measures(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """SCHEMA for every document."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        words = _Vocabulary(vocabulary_path(vocabulary))
        for b in batches:
            texts = text_bytes(b.column("text"))
            for part in batches_of([len(t) for t in texts], BATCH_BYTES):
                found = measure(texts[part], words)
                own = {c: b.column(c).slice(part.start, part.stop - part.start)
                       for c in ("doc_id", "lang")}
                yield pa.RecordBatch.from_arrays(
                    [own[c] if c in own else pa.array(
                        found[c], pa.float64() if f"{c} double" in SCHEMA else pa.int64())
                     for c in names], names)

    narrow_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, SCHEMA)


def _quantile(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Median of ``value`` by ``keys`` in steps of STEP: counts by step first, so a group's
    rows are never brought together."""
    w = Window.partitionBy(*keys).orderBy("at")
    return (rows.withColumn("at", F.round(F.col(value) / STEP).cast("long"))
            .groupBy(*keys, "at").count()
            .withColumn("upto", F.sum("count").over(w))
            .withColumn("all", F.sum("count").over(Window.partitionBy(*keys)))
            .where(2 * F.col("upto") >= F.col("all"))
            .groupBy(*keys).agg((F.min("at") * STEP).alias(name), F.max("all").alias("n")))


def bands(measured: DataFrame, width: float = WIDTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row a group with a map from measure to its bands (octave, median, half), from the rows
    (group, n_tokens, MEASURES) that the plain rules pass. Octave null is all lengths."""
    nothing = F.lit(None).cast("long")
    long = measured.select("group", F.explode(F.array(*[
        F.struct(F.lit(m).alias("band"), o.alias("octave"), F.col(m).alias("value"), F.lit(least).alias("least"))
        for m, least in zip(MEASURES, LEAST)
        for o in ([nothing] if m == "byte_share" else [nothing, _octave()])])).alias("x")).select("group", "x.*")
    long = long.withColumn("octave", F.coalesce("octave", F.lit(-1)))
    keys = ["group", "band", "octave", "least"]
    mid = stored(_quantile(long, keys, "value", "median"), "medians")
    off = long.join(mid.select(*keys, "median"), keys).withColumn(
        "off", F.abs(F.col("value") - F.col("median")))
    spread = _quantile(off, keys, "off", "mad").select(*keys, "mad")
    half = F.greatest(F.lit(width * 1.4826) * F.col("mad"), F.col("least"))
    return (mid.join(spread, keys).where(F.col("n") >= min_documents)
            .groupBy("group", "band").agg(F.collect_list(F.struct(
                F.when(F.col("octave") >= 0, F.col("octave")).alias("octave"), "median",
                half.alias("half"))).alias("found"))
            .groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("band", "found"))).alias("bands")))


def _octave():
    return F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")))


def _limits(name: str):
    """(low, high) that a row's measure is held against, from the nearest octave of its language
    that has a band, else from all lengths; null without either."""
    far = F.lit(1 << 20).cast("long")  # all lengths come last
    band = F.array_min(F.transform(F.try_element_at("own", F.lit(name)), lambda x: F.struct(
        F.coalesce(F.abs(x["octave"] - _octave()), far).alias("distance"), x["octave"].alias("octave"),
        x["median"].alias("median"), x["half"].alias("half"))))
    shorter = F.coalesce(F.greatest(band["octave"] - _octave(), F.lit(0)), F.lit(0))
    longer = F.coalesce(F.greatest(_octave() - band["octave"], F.lit(0)), F.lit(0))
    if name == "entropy":  # twice the tokens add one bit at most
        return band["median"] - band["half"] - shorter, band["median"] + band["half"] + longer
    half = band["half"] * F.pow(F.lit(2.0), shorter / 2)  # means of fewer words deviate more
    return band["median"] - half, band["median"] + half


def judge(docs: DataFrame, vocabulary: str = VOCABULARY, width: float = WIDTH,
          min_documents: int = MIN_DOCUMENTS, **columns) -> DataFrame:
    """SCHEMA with base_failed, rejected_by (measures out of band) and kept."""
    rows = measures(docs, vocabulary, **columns)
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))
    rows = stored(rows.withColumn("base_failed", failed).withColumn("group", group), "fertility")
    found = stored(bands(rows.where(~F.col("base_failed")), width, min_documents), "bands")
    out = rows.join(found.withColumnRenamed("bands", "own"), "group", "left")
    outside = []
    for m in MEASURES:
        low, high = _limits(m)
        outside.append(F.when((F.col(m) < low) | (F.col(m) > high), F.lit(m)))
    out = out.withColumn("rejected_by", F.array_compact(F.array(*outside)))
    return (out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
            .drop("group", "own"))


def op7_fertility_rules(spark, sf_dir: str) -> DataFrame:
    """Plain counts and verdict for all documents."""
    return judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "chars_per_token", "byte_share", "entropy")
