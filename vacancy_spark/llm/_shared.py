"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vacancy_spark.llm._words import text_bytes
from vacancy_spark.session import fresh_path

BATCH_ROWS = 1024  # rows of whole texts that one Arrow batch may hold


def narrow_batches(spark: SparkSession) -> None:
    """Texts can be long: lower Spark's default of 10,000 rows a batch (a user's own value stays)."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def hand_back() -> None:
    """Give the memory that this process no longer uses back to the system (workers live on between tasks)."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A function over batches, as ``run``, that hands memory back when its task is done."""
    def over(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return over


_steps: ContextVar[list[str] | None] = ContextVar("steps", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the cluster's shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _steps.get() is not None:
        _steps.get().append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_alone(make, name: str) -> DataFrame:
    """The frame that ``make()`` returns, ``stored``; the tables that were stored on the way are deleted."""
    paths: list[str] = []
    token = _steps.set(paths)
    try:
        df = make()
        _steps.set(None)
        out = stored(df, name)
    finally:
        _steps.reset(token)
    spark = out.sparkSession
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with its column ``text`` compressed, to be shuffled at a third of their size."""
    rest = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*docs.select(rest).schema.fields, T.StructField("packed", T.BinaryType())])

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(rest))),
                 pa.array([pack(t) for t in text_bytes(b.column("text"))], pa.binary())],
                schema=pa.schema([*(pa.field(f"c{i}", b.column(i).type) for i in range(len(rest))),
                                  pa.field("packed", pa.binary())])).rename_columns([*rest, "packed"])

    return docs.select(*rest, "text").mapInArrow(tidy(run), schema)


def unpacked(column) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in column.to_pylist()]
