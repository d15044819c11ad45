"""Events and metadata bucketed by vacancy.

Catalog tables with ``bucketBy(key).sortBy(key, ...)``: joins and aggregates by vacancy read files that
already lie together, so neither side is shuffled. A bucket is read by one task; vacancies with more
events than a bucket should hold (and rows without a vacancy) would make one task read them all, so they
are kept aside in a table without buckets. There are fewer such vacancies than buckets, as each holds
more than an average bucket's rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, metrics
from ..session import fresh_path


@dataclass(frozen=True)
class Bucketed:
    """``rest``: the bucketed table; ``hot``: the rows kept aside; no key is in both."""

    rest: DataFrame
    hot: DataFrame
    key: str
    hot_keys: list

    def each(self, step) -> DataFrame:
        """``step`` applied to both parts; right for whatever treats each key's rows by themselves."""
        return step(self.rest).unionByName(step(self.hot))


def write_bucketed(df: DataFrame, name: str, key: str, sort: list[str], buckets: int, split_hot: bool = True,
                   location: str | None = None) -> Bucketed:
    """Store ``df`` as catalog tables ``name`` and ``name_hot`` (runs jobs). ``split_hot=False``: for
    tables of one row a key."""
    spark = df.sparkSession
    location = location or fresh_path(spark, f"bucketed-{name}")
    hot_keys, is_hot = [], F.col(key).isNull()
    if split_hot:
        counts = fresh_path(spark, "bucket-counts")
        df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).write.parquet(counts)
        counts = spark.read.parquet(counts)
        limit = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // buckets)
        hot_keys = sorted(r[0] for r in counts.where((F.col("n") > limit) & F.col(key).isNotNull()).collect())
        if hot_keys:
            is_hot = is_hot | F.col(key).isin(hot_keys)
    is_hot = F.coalesce(is_hot, F.lit(False))
    (df.where(~is_hot).repartition(buckets, key).write.mode("overwrite").format("parquet")
       .bucketBy(buckets, key).sortBy(key, *sort).option("path", f"{location}/rest").saveAsTable(name))
    df.where(is_hot).write.mode("overwrite").format("parquet").option("path", f"{location}/hot").saveAsTable(f"{name}_hot")
    return open_bucketed(spark, name, key)


def open_bucketed(spark: SparkSession, name: str, key: str) -> Bucketed:
    hot = spark.table(f"{name}_hot")
    keys = [r[0] for r in hot.where(F.col(key).isNotNull()).select(key).distinct().collect()]
    return Bucketed(spark.table(name), hot, key, sorted(keys))


def vacancy_counts(events: Bucketed, *dims) -> DataFrame:
    """``metrics.vacancy_counts`` without a shuffle of the bucketed rows."""
    return events.each(lambda df: metrics.vacancy_counts(df, *dims, entity=events.key))


def join_metadata(events: Bucketed, meta: Bucketed) -> DataFrame:
    """``joins.join_metadata`` (rows in no order) bucket by bucket. The hot vacancies' few metadata
    rows are joined with the rows kept aside by themselves."""
    if events.key != "entity_id" or meta.key != "entity_id":
        raise ValueError("both sides are bucketed by entity_id")
    few = meta.rest.where(F.col("entity_id").isin(events.hot_keys) if events.hot_keys else F.lit(False))
    return (joins.join_metadata(events.rest, meta.rest, order=False)
            .unionByName(joins.join_metadata(events.hot, few, order=False)))
