"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancy_spark.llm._shared import stored


def _star(edges: DataFrame) -> DataFrame:
    """For each node its smallest neighbour or itself (u, m); ``edges`` are (u, v)."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node in ``edges`` (a, b: long): the smallest node reachable.

    Every step is a shuffle of the edges; its result is written, so a lost executor costs one
    step. Ends when the smallest neighbours no longer change. Loops and repeats are allowed.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = edges.where("a < b")
    seen = None
    while True:
        # large star: every larger neighbour of u moves to u's smallest neighbour
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        moved = (both.where("v > u").join(_star(both), "u")
                 .select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct())
        # small star: u and its smaller neighbours move to the smallest of them
        down = moved.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = _star(down)
        edges = stored(down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
                       .unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
                       .where("a < b").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return (nodes.join(edges.select(F.col("b").alias("node"), F.col("a").alias("component")),
                       "node", "left")
            .select("node", F.coalesce("component", "node").alias("component")))
