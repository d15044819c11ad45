"""Region columns on whole tables.

Address parsing costs a few microseconds per row, so the table-level helpers keep it off the
hot path: the stripped / lower-cased address and the city part are computed once per row as
their own columns (Catalyst does not inline an expensive expression that is used several
times), and the summary aggregates BEFORE parsing, so each distinct address is parsed once
per task instead of once per event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regions import (UNKNOWN, city_lookup, keyword_lookup, region_from_address,
                                 region_from_postcode)
from ..functions.text import trim_ws

_TMP = ("_rg_trim", "_rg_low", "_rg_city")


def with_region(df: DataFrame, address_col: str, out: str = "uk_region",
                postcode_mode: str = "reference") -> DataFrame:
    """Add ``out`` = region of ``address_col`` (same result as ``region_from_address``)."""
    a = F.col(address_col)
    staged = (df.withColumn("_rg_trim", trim_ws(a))
                .withColumns({"_rg_low": F.lower("_rg_trim"),
                              "_rg_city": F.lower(trim_ws(F.get(F.split("_rg_trim", ","), 1)))}))
    found = F.coalesce(city_lookup(F.col("_rg_trim"), F.col("_rg_city")),
                       region_from_postcode(a, postcode_mode),
                       keyword_lookup(F.col("_rg_low")))
    region = F.when(a.isNull() | (a == ""), F.lit(UNKNOWN)).otherwise(F.coalesce(found, F.lit(UNKNOWN)))
    return staged.withColumn(out, region).drop(*_TMP)


def with_region_of_locations(df: DataFrame, col: str = "location_full", out: str = "uk_region",
                             postcode_mode: str = "reference") -> DataFrame:
    """Add ``out`` = region of a pipe list (same result as ``region_from_locations``): a single
    location takes the staged columns, only real lists go through the higher-order parser."""
    c = F.col(col)
    one = with_region(df.withColumn("_rg_one", trim_ws(c)), "_rg_one", "_rg_single", postcode_mode)
    known = F.filter(F.transform(F.split(c, r"\|"), lambda x: region_from_address(trim_ws(x), postcode_mode)),
                     lambda r: r != F.lit(UNKNOWN))
    return one.withColumn(out, F.when(c.isNull() | (c == ""), F.lit(UNKNOWN))
                          .when(~c.contains("|"), F.col("_rg_single"))
                          .otherwise(F.coalesce(F.get(known, 0), F.lit(UNKNOWN)))
                          ).drop("_rg_one", "_rg_single")


def add_region_column(df: DataFrame, address_col: str | None = None,
                      postcode_mode: str = "reference") -> DataFrame:
    """``uk_region`` from ``address_col`` when given; otherwise from the export's pipe list
    ``location_full`` if present, else from the raw ``regions`` address, else ``'Unknown'``."""
    if address_col:
        return with_region(df, address_col, "uk_region", postcode_mode)
    if "location_full" in df.columns:
        return with_region_of_locations(df, "location_full", "uk_region", postcode_mode)
    if "regions" in df.columns:
        return with_region(df, "regions", "uk_region", postcode_mode)
    return df.withColumn("uk_region", F.lit(UNKNOWN))


def region_summary(df: DataFrame, address_col: str = "regions",
                   postcode_mode: str = "reference") -> DataFrame:
    """Rows per derived region, most frequent first.

    Rows are first counted per address (partial aggregation inside each task), the address
    is parsed once per distinct value, and the per-region sums are a second small aggregate.
    """
    per_address = df.groupBy(address_col).agg(F.count(F.lit(1)).alias("_n"))
    return (with_region(per_address, address_col, "uk_region", postcode_mode)
            .groupBy("uk_region").agg(F.sum("_n").cast("bigint").alias("count"))
            .orderBy(F.desc("count"), "uk_region"))
