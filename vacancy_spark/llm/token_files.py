"""Token ids in Parquet files made for selective reads.

One row per document in ascending id order. ``tokens`` is a list column whose ids are written
through a dictionary (bit-packed indexes into the distinct ids of the row group); the id and
count columns are delta-encoded. Row groups and pages are bounded, and every page is listed in
the page index, so a reader of counts touches no token page and a reader of a few documents
touches few pages. ``read_counts``, ``read_tokens`` and ``starts`` read the files back.

Nulls are empty texts, which hold the end id alone. Documents of equal id are ordered by a hash
of their text; a null id comes first. Extra columns are ignored, whatever their names; an empty
table gives a readable file set without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacancy_spark.llm._encode import keeps_space, vocabulary_path, worker_encoder
from vacancy_spark.llm._shared import documents, narrow_batches, tidy
from vacancy_spark.session import fresh_path

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
SCHEMA = "doc_id long, text_hash long, n_tokens long, tokens array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json",
                 end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                 row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Encode every text, append ``end_id`` and write the files under ``path``.

    The texts are shuffled by id range, not their ids (about three times as large), and encoded
    where they are written.
    """
    spark = docs.sparkSession
    narrow_batches(spark)

    def encode(batches):
        encoder = worker_encoder(vocabulary_path(vocabulary), keeps_space(vocabulary))
        for b in batches:
            ids, counts = encoder.encode(b.column("text").to_pylist())
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype(np.int32)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(counts + 1, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))],
                ["doc_id", "text_hash", "n_tokens", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    (rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
     .mapInArrow(tidy(encode), SCHEMA).write
     .option("parquet.writer.version", "v2")
     .option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#doc_id", "false")
     .option("parquet.enable.dictionary#text_hash", "false")
     .option("parquet.enable.dictionary#n_tokens", "false")
     .option("parquet.block.size", str(row_group_bytes))
     .option("parquet.page.size", str(page_bytes))
     .option("parquet.page.row.count.limit", str(PAGE_ROWS))
     .option("compression", "zstd").parquet(path))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens: metadata alone, no token page is read."""
    return spark.read.schema(SCHEMA).parquet(path).select("doc_id", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None,
                last_id: int | None = None) -> DataFrame:
    """doc_id, tokens of a range of ids (all by default); the page index skips other pages."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first_id is not None:
        rows = rows.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.where(F.col("doc_id") <= last_id)
    return rows.select("doc_id", "tokens")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """file, doc_id, text_hash, place, start: ids of all documents before each one.

    Each file is a run of the order, so the sums of whole files are few and the running sum
    within a file is that of one task's output.
    """
    rows = (spark.read.schema(SCHEMA).parquet(path)
            .select("doc_id", "text_hash", "n_tokens",
                    F.col("_metadata.file_path").alias("file")))
    files = (rows.groupBy("file").agg(F.min(F.struct("doc_id", "text_hash")).alias("low"),
                                      F.sum("n_tokens").alias("total")))
    before = files.select("file", F.coalesce(F.sum("total").over(
        Window.orderBy("low", "file").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy("doc_id", "text_hash")
    return (rows.withColumn("place", F.row_number().over(inside))
            .withColumn("inside", F.sum("n_tokens").over(
                inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
            .join(F.broadcast(before) if _few_files(spark, path) else before, "file")
            .select("file", "doc_id", "text_hash", "place", "n_tokens",
                    (F.col("before") + F.col("inside")).alias("start")))


def _few_files(spark: SparkSession, path: str, most: int = 100_000) -> bool:
    """Whether the list of the path's files is known to be small enough to broadcast."""
    return len(spark.read.schema(SCHEMA).parquet(path).inputFiles()) <= most


def digests(spark: SparkSession, path: str) -> DataFrame:
    """file, place (order in the file), ids_crc32 of each document's ids as little-endian uint32."""
    def digest(batches):
        for b in batches:
            tokens = b.column("tokens")
            flat = tokens.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(np.diff(tokens.offsets.to_numpy()))
            crc = [zlib.crc32(flat[a:z].data) for a, z in zip(np.r_[0, ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("file", "doc_id", "text_hash")),
                 pa.array(crc, pa.int64())], ["file", "doc_id", "text_hash", "ids_crc32"])

    narrow_batches(spark)
    rows = (spark.read.schema(SCHEMA).parquet(path)
            .select(F.col("_metadata.file_path").alias("file"), "doc_id", "text_hash", "tokens"))
    return rows.mapInArrow(tidy(digest), "file string, doc_id long, text_hash long, ids_crc32 long")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """Write all documents' ids with byte_bpe_50k.json, read the files back and digest them."""
    path = fresh_path(spark, "token-files")
    write_tokens(documents(spark, sf_dir), path)
    inside = Window.partitionBy("file").orderBy("doc_id", "text_hash")
    found = digests(spark, path).withColumn("place", F.row_number().over(inside))
    return (starts(spark, path).join(found.select("file", "place", "ids_crc32"),
                                     ["file", "place"])
            .select("doc_id", "start", "n_tokens", "ids_crc32"))
