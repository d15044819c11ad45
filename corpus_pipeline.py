"""Corpus preparation in stages, each written as Parquet and read again by the next one.

Toxic documents go, one document of each group of near-duplicates stays, repeated passages are
cut out of the texts, sources are mixed to target weights, and the mix is packed into sequences.
A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``docs``, whatever further columns it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancy_spark.llm import mixing, near_duplicates, packing, suffix_dedup, toxicity
from vacancy_spark.session import fresh_path

TOXIC_FROM = 0.5  # documents with this score or more are rejected


def _boxed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all columns as one, so that no name can clash."""
    return docs.select(*names, F.struct(*docs.columns).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the factorization machine, learned from the labels, scores below
    TOXIC_FROM."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.train(docs, labels, F.lit(True))
    return (toxicity.score(_boxed(docs, "text"), machine)
            .where(F.col("score") < TOXIC_FROM).select("row.*"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more: the one of smallest id."""
    return near_duplicates.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that appear again; n_chars follows.

    Of a character that a cut goes through, nothing stays. A null text stays null.
    """
    out = suffix_dedup.remove_repeats(_boxed(docs, "doc_id", "text"), with_text=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    taken = mixing.mix(_boxed(docs, "doc_id", "text", "source"), keep=("row",))
    return (taken.where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
            .select("row.*"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of the mix in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# learned scores, sampled paths, suffixes and tokens are beyond SQL; tests/llm has a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = fresh_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
