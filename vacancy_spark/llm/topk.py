"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt into blocks of rows, queries into blocks of queries; each pair of blocks is one
task. A task keeps one list of its rows per dimension, sorted by that component, and reads the
lists from the end that the query's sign favours. A row seen in any list is scored in full at
once. No row still unseen can score more than the inner product of the query with the values the
lists have come to; when that bound is below the k-th best score, the query is done. The best of
all blocks are merged by rank.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an
id. Vectors are compared with those of as many components. Rows that repeat an id are candidates
(or queries) each, but never of a query with their own id. Ties go to the smaller id. An empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancy_spark.llm._shared import stored

K = 10
ROW_BLOCK = 8192
QUERY_BLOCK = 4096
SCALE = 1024
FOUND = "query_no long, query_id long, vec_id long, score long"


def _whole(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both arrays of whole numbers in a type in which their inner products are exact."""
    most = (np.abs(x).max(initial=0) * np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if most < 2**53:
        return x, y
    kind = np.int64 if most < 2**62 else object
    as_kind = lambda v: np.array([[int(a) for a in r] for r in v], dtype=kind).reshape(v.shape)
    return as_kind(x), as_kind(y)


def threshold_top_k(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray,
                    k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, score) of every query's k best rows of other ids."""
    rows, queries = _whole(rows, queries)
    n, dims = rows.shape
    lists = np.argsort(rows, axis=0, kind="stable")
    values = np.take_along_axis(rows, lists, axis=0)
    at = np.arange(dims)
    which, where, scores = [], [], []
    for i, q in enumerate(queries):
        up = q < 0  # read upwards where a small component is good
        seen = ids == query_ids[i]
        best = np.zeros(0, np.int64)
        best_score = np.zeros(0, rows.dtype)
        depth, step = 0, 4
        while depth < n:
            upto = min(n, depth + step)
            new = np.zeros(n, bool)
            new[lists[depth:upto, up]] = True
            new[lists[n - upto:n - depth, ~up]] = True
            new &= ~seen
            if upto == n or 2 * (np.count_nonzero(seen) + np.count_nonzero(new)) > n:
                new, upto = ~seen, n  # most rows are seen: read the lists to their end
            got = np.flatnonzero(new)
            seen |= new
            best = np.concatenate([best, got])
            best_score = np.concatenate([best_score, rows[got] @ q])
            order = np.lexsort((ids[best], -best_score))[:k]
            best, best_score = best[order], best_score[order]
            depth, step = upto, step * 4
            if depth < n and len(best) == k:
                reached = values[np.where(up, depth, n - 1 - depth), at]
                if best_score[-1] > reached @ q:
                    break
        which.append(np.full(len(best), i))
        where.append(best)
        scores.append(best_score)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(which).astype(np.int64), join(where).astype(np.int64), join(scores)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE,
          id_col: str = "vec_id", vector_col: str = "embedding", row_block: int = ROW_BLOCK,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every row for which ``is_query`` holds.

    Components are taken as floor(scale * x). ``is_query`` is a condition on the input's columns.
    """
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(x.cast("double")) == float("inf")))
    rows = stored(vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
                  .select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vector_col).cast("array<double>").alias("vector"),
                          F.coalesce(is_query, F.lit(False)).alias("is_query"))
                  .withColumn("row_no", F.monotonically_increasing_id()), "vectors")
    queries = rows.where("is_query")
    n_rows = -(-rows.count() // row_block) or 1
    n_queries = -(-queries.count() // query_block) or 1
    block = lambda n: F.pmod(F.xxhash64("row_no"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = (rows.withColumn("is_query", F.lit(False))
             .select("*", block(n_rows).alias("rows"), every(n_queries).alias("queries"))
             .unionByName(queries.select("*", block(n_queries).alias("queries"),
                                         every(n_rows).alias("rows"))))

    def search(table: pa.Table) -> pa.Table:
        vector = table.column("vector").combine_chunks()
        x = vector.flatten().to_numpy(zero_copy_only=False)
        x = np.floor(x * scale).reshape(len(table), len(x) // len(table))
        asks = table.column("is_query").to_numpy().astype(bool)
        ids, number = table.column("vec_id").to_numpy(), table.column("row_no").to_numpy()
        q, r, score = threshold_top_k(x[~asks], ids[~asks], x[asks], ids[asks], k)
        return pa.table({"query_no": number[asks][q], "query_id": ids[asks][q],
                         "vec_id": ids[~asks][r],
                         "score": pa.array([int(s) for s in score], pa.int64())})

    found = (dealt.groupBy("rows", "queries", F.size("vector").alias("dims"))
             .applyInArrow(search, FOUND))
    rank = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op5_threshold_top_k(spark, sf_dir: str) -> DataFrame:
    """The 10 best rows of all embeddings for each query row."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
