"""Mixing sources to target weights by Pareto order sampling.

Sources in code point order (null last) take the given weights in turn and share a budget of
words by weight. A target stops at ``max_copies`` times its source's size; the excess is shared
anew by weight until none is above. A document of a source with target T and size S is expected
T / S times: its whole copies are certain, and the fraction f is the inclusion probability of
one copy more. Documents are ranked by (u / (1 - u)) / (f / (1 - f)), the random odds divided by
the inclusion odds, u being a hash of id and seed; in that order they fill what the target
leaves after the whole copies, the last one only if that comes nearer to it. The sample's size
is thus fixed in words, to half a document.

The running sum is not taken over a whole source in one task: ranks are cut into 4096 equal
ranges of u, the ranges' sums tell which one the cut falls in, and only that range is ordered
(after a second cut into 4096).

Null texts have size 0, null sources are one source. Repeated ids have equal ranks and are
ordered by size. Reruns agree. Extra columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancy_spark.llm._shared import documents, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
SEED = "mix"
RANGES = 4096
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of the text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(doc_id: Column, seed: str) -> Column:
    """52 bits of a digest of id and seed as a number between 0 and 1, both excluded."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
            max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target of every source in ``sizes`` (source, size): one row each.

    Sources are capped in the order of cap / weight: one is capped if the budget left, shared
    by the weights left, reaches its cap. That is the end of the repeated resharing.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    one = Window.partitionBy(F.lit(0))  # one row a source
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    fill = one.orderBy("ratio", "rank")
    rows = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("rank", F.row_number().over(by_name)).withColumn("weight", w)
            .withColumn("budget", F.lit(share) * F.sum("source_size").over(one))
            .withColumn("cap", F.lit(float(max_copies)) * F.col("source_size"))
            .withColumn("ratio", F.col("cap") / F.col("weight")))
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
            .withColumn("weight_left", F.sum("weight").over(
                fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
            .withColumn("is_free", F.col("ratio") > F.col("left") / F.col("weight_left")))
    # the level is that of the first source below its cap
    level = F.min(F.when(F.col("is_free"), F.struct("ratio", "rank", "left", "weight_left"))).over(one)
    return (rows.withColumn("level", level)
            .withColumn("target", F.when(F.col("is_free"), F.col("weight") * F.col("level.left")
                                         / F.col("level.weight_left")).otherwise(F.col("cap")))
            .select("source", "source_size", "target"))


def _below_cut(rows: DataFrame, cut: DataFrame, level: str) -> DataFrame:
    """``cut`` (source, need, before) with the range of ``level`` in which each cut falls:
    adds <level> and replaces ``before`` by the words of the ranges below it."""
    sums = rows.groupBy("source_no", level).agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source_no").orderBy(level)
    run = (sums.withColumn("upto", F.sum("words").over(w))
           .join(cut, "source_no").withColumn("low", F.col("before") + F.col("upto") - F.col("words")))
    first = run.where(F.col("before") + F.col("upto") > F.col("need"))
    return (first.groupBy("source_no")
            .agg(F.min(F.struct(level, F.col("low").alias("before"))).alias("x"),
                 F.first("need").alias("need"))
            .select("source_no", "need", f"x.{level}", "x.before"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES,
        seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document.

    ``copies`` counts the document's copies in the mix, ``taken`` their words. ``keep`` names
    further columns to carry along.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       word_count(F.col(text_col)).alias("size"), *keep)
    rows = stored(base.withColumn("u", _uniform(F.col("doc_id"), seed)), "mix-sizes")

    f = F.col("target") / F.col("source_size")
    plan = targets(rows, weights, share, max_copies)
    plan = (plan.withColumn("source_no", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
        .withColumn("certain", F.when(F.col("source_size") > 0, F.floor(f)).otherwise(0).cast("long"))
        .withColumn("inclusion", F.when(F.col("source_size") > 0, f - F.floor(f)).otherwise(0.0))
        .withColumn("need", F.col("target") - F.col("certain") * F.col("source_size")))
    # written: a handful of rows whose size is then known, so the join below broadcasts them
    plan = stored(plan, "mix-targets")

    same = rows["source"].eqNullSafe(plan["source"])
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("inclusion") / (1 - F.col("inclusion")))
    rows = (rows.join(plan, same).select(rows["*"], *[plan[c] for c in plan.columns if c != "source"])
            .withColumn("rank_odds", F.when(F.col("inclusion") > 0, odds))
            # equal ranges of u are ranges of the ranking, since f is one number for a source
            .withColumn("range", F.floor(F.col("u") * RANGES))
            .withColumn("subrange", F.floor(F.col("u") * RANGES * RANGES)))
    open_ = rows.where(F.col("inclusion") > 0)
    cut = plan.where(F.col("inclusion") > 0).select("source_no", "need",
                                                    F.lit(0).cast("long").alias("before"))
    coarse = _below_cut(open_.select("source_no", "range", "size"), cut, "range")
    inside = (open_.join(coarse.select("source_no", "range"), ["source_no", "range"])
              .select("source_no", "subrange", "size"))
    fine = stored(_below_cut(inside, coarse.drop("range"), "subrange"), "mix-cuts")

    rows = rows.join(fine.select("source_no", F.col("subrange").alias("cut_at"), "before"),
                     "source_no", "left")
    # without a cut the whole source fits; below it a document is in, above it out
    sure = F.coalesce(F.col("subrange") < F.col("cut_at"), F.col("inclusion") > 0)
    clear = rows.where(F.col("cut_at").isNull() | (F.col("subrange") != F.col("cut_at")))
    order = Window.partitionBy("source_no").orderBy("rank_odds", "doc_id", "size")
    near = (rows.where(F.col("subrange") == F.col("cut_at"))
            .withColumn("low", F.col("before") + F.sum("size").over(
                order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
            .withColumn("extra", F.col("low") + F.col("size") / 2 <= F.col("need")).drop("low"))
    copies = F.col("certain") + F.col("extra").cast("long")
    return (clear.withColumn("extra", sure).unionByName(near)
            .select("doc_id", "source", "size", "source_size", "target",
                    copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep))


def op1_pareto_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: words taken of each."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH s AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix'), 1, 13)
               AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
a AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM s GROUP BY source),
b AS (
  SELECT *, list_extract(CAST([3, 1, 2] AS DOUBLE[]), (rnk - 1) % 3 + 1) AS weight,
         CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS budget,
         CAST(2 * source_size AS DOUBLE) AS cap FROM a),
c AS (
  SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, rnk
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_rest FROM b),
d AS (
  SELECT *, cap / weight > rest / weight_rest AS is_free FROM c),
e AS (
  SELECT *, first_value(rest) OVER (ORDER BY NOT is_free, cap / weight, rnk) AS level_rest,
         first_value(weight_rest) OVER (ORDER BY NOT is_free, cap / weight, rnk) AS level_weight
  FROM d),
t AS (
  SELECT source, source_size,
         CASE WHEN is_free THEN weight * level_rest / level_weight ELSE cap END AS target FROM e),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END
         AS certain FROM t),
q AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.certain, s.u,
         CASE WHEN p.source_size > 0 THEN p.target / p.source_size - p.certain ELSE 0 END AS f,
         p.target - p.certain * p.source_size AS need,
         row_number() OVER (ORDER BY s.source NULLS LAST) * 0 + dense_rank()
           OVER (ORDER BY s.source NULLS LAST) AS source_no
  FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source),
r AS (
  SELECT *, sum(size) OVER (PARTITION BY source_no
            ORDER BY CASE WHEN f > 0 THEN (u / (1 - u)) / (f / (1 - f)) END, doc_id NULLS FIRST, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS low FROM q)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (certain + CASE WHEN f > 0 AND low + size / 2.0 <= need THEN 1 ELSE 0 END)
            AS BIGINT) AS taken
FROM r
"""
