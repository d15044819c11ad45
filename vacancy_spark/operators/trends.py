"""Daily trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import APPLY, CLICK
from ..session import fresh_path
from .metrics import events_in, events_where


def daily_trend(df: DataFrame, date_col: str = "event_date") -> DataFrame:
    """Clicks and applies per day, ascending; days with neither are absent, missing side 0.

    One conditional aggregate replaces the reference's two group-bys and outer join.
    """
    return (df.groupBy(F.col(date_col).cast("date").alias("event_date"))
              .agg(events_where(df, F.col("event_name") == CLICK).alias("clicks"),
                   events_where(df, F.col("event_name") == APPLY).alias("applies"))
              .where((F.col("clicks") > 0) | (F.col("applies") > 0))
              .orderBy("event_date"))


def daily_trend_outer_join(df: DataFrame, date_col: str = "event_date") -> DataFrame:
    """The reference's literal form: daily clicks FULL OUTER JOIN daily applies, nulls -> 0.

    The events are scanned once: their counts by day and event name, a few rows a day, are
    written to the shared folder (by a job when called) and both sides are read from there.
    Kept to show equivalence with ``daily_trend``; prefer that one (one shuffle, no join).
    """
    spark = df.sparkSession
    path = fresh_path(spark, "daily_counts")
    (df.where(F.col("event_name").isin(CLICK, APPLY))
       .groupBy(F.col(date_col).cast("date").alias("event_date"), "event_name")
       .agg(events_in(df).alias("n")).write.parquet(path))
    daily = spark.read.parquet(path)
    clicks = daily.where(F.col("event_name") == CLICK).select("event_date", F.col("n").alias("clicks"))
    applies = daily.where(F.col("event_name") == APPLY).select("event_date", F.col("n").alias("applies"))
    return (clicks.join(applies, "event_date", "full_outer")
                  .select("event_date",
                          F.coalesce("clicks", F.lit(0)).alias("clicks"),
                          F.coalesce("applies", F.lit(0)).alias("applies"))
                  .orderBy("event_date"))


def daily_counts(df: DataFrame, date_col: str = "event_date") -> DataFrame:
    """Events per day (all event names); rows with no parseable day are skipped."""
    d = F.col(date_col).cast("date")
    return (df.where(d.isNotNull())
              .groupBy(d.alias("date"))
              .agg(events_in(df).alias("count"))
              .orderBy("date"))
