"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content together with a digest of the tokenizer
(file bytes and library version). Counts are looked up in a stored table by that key; only one
row of each key that is missing is encoded, and its count is appended to the table.

Nulls count as empty texts. Repeated rows share one encoding and each get a result row; ids may
repeat or be null. Extra columns are ignored, whatever their names; an empty table gives no rows
and leaves the cache as it is.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancy_spark.llm._encode import ChunkEncoder, keeps_space, vocabulary_path
from vacancy_spark.llm._shared import documents, narrow_batches, stored
from vacancy_spark.session import fresh_path

CACHE_SCHEMA = "tokenizer_digest string, content_digest binary, n_tokens long"
TOKEN_LIMIT = 2048


def tokenizer_digest(vocabulary: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    import tokenizers

    with open(vocabulary_path(vocabulary), "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def _normalised(text, vocabulary: str):
    """Content with the differences removed that can't change a count: a vocabulary that drops
    white space sees any run of it as one space."""
    if keeps_space(vocabulary):
        return text
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def count_tokens(docs: DataFrame, cache_path: str, vocabulary: str = "word_bpe_49k.json",
                 limit: int = TOKEN_LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cached (the count was in the cache before).

    ``cache_path`` is a Parquet table that this call appends to (created when it is not there).
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    version = tokenizer_digest(vocabulary)
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"),
                        F.unhex(F.sha2(_normalised(text, vocabulary), 256)).alias("content_digest"))
    keys = stored(whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                               "content_digest"), "token-keys")

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    before = stored(spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
                    .where(F.col("tokenizer_digest") == version)
                    .groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")),
                    "token-cache-before")

    # one row of each missing digest; min() combines before the shuffle, however hot a digest is
    misses = (keys.groupBy("content_digest").agg(F.min("doc_id").alias("miss_id"))
              .join(before.select("content_digest"), "content_digest", "left_anti"))

    def encode(batches):
        encoder = ChunkEncoder(vocabulary_path(vocabulary), keeps_space(vocabulary))
        for b in batches:
            _, counts = encoder.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("content_digest"), pa.array(counts, pa.int64())],
                ["content_digest", "n_tokens"])

    found = (whole.join(misses.select(F.col("miss_id"), F.col("content_digest").alias("miss")),
                        (F.col("content_digest") == F.col("miss"))
                        & F.col("doc_id").eqNullSafe(F.col("miss_id")), "left_semi")
             .mapInArrow(encode, "content_digest binary, n_tokens long"))
    # rows that repeat one id and text are the same miss; one entry is kept
    (found.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
     .select(F.lit(version).alias("tokenizer_digest"), "content_digest", "n_tokens")
     .write.mode("append").parquet(cache_path))

    after = (spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
             .where(F.col("tokenizer_digest") == version)
             .groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
             .join(before.select("content_digest", F.lit(True).alias("cached")),
                   "content_digest", "left"))
    return keys.join(after, "content_digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
        F.coalesce("cached", F.lit(False)).alias("cached"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of all documents with word_bpe_49k.json; the cache starts empty."""
    return count_tokens(documents(spark, sf_dir), fresh_path(spark, "token-cache"))
