"""Regions of addresses, kept in a stored dictionary.

Parsing an address takes a dozen pattern searches, and events repeat a few addresses millions of times.
The dictionary is a published table of (digest of the address, parser, region): addresses of a frame that it
does not have are parsed once, each, and appended; the frame is then joined with it. ``parser``
names the rules (code and tables), the postcode mode and whether lists are read, so a changed rule
never meets old results.
"""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import regions as rules
from ..operators import regions as operators
from ..operators.regions import with_region, with_region_of_locations
from ..session import fresh_path, shared_dir
from . import published

UNKNOWN = rules.UNKNOWN


def default_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/vacancy_spark/address_regions"


def parser_name(postcode_mode: str, listed: bool) -> str:
    code = inspect.getsource(rules) + inspect.getsource(operators)
    return f"{hashlib.sha256(code.encode()).hexdigest()[:16]}-{postcode_mode}-{'list' if listed else 'single'}"


def _digest(c: Column) -> Column:
    return F.sha2(c, 256)


def _known(spark: SparkSession, path: str, parser: str, m: published.Manifest | None) -> DataFrame | None:
    if m is None:
        return None
    return published.open_table(spark, path, version=m.version).where(F.col("parser") == parser).select("digest", "region")


def learn_addresses(df: DataFrame, column: str, path: str | None = None, postcode_mode: str = "reference",
                    listed: bool = False) -> int:
    """Add the addresses of ``df`` that the dictionary lacks; returns how many were parsed. (Runs jobs.)

    If another writer extends the dictionary meanwhile, what is new is looked up again, so that no
    address is in it twice.
    """
    spark = df.sparkSession
    path, parser = path or default_path(spark), parser_name(postcode_mode, listed)
    distinct = fresh_path(spark, "addresses")
    (df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(column).alias("address")).distinct()
       .withColumn("digest", _digest(F.col("address"))).write.parquet(distinct))
    addresses = spark.read.parquet(distinct)
    parse = with_region_of_locations if listed else with_region
    for _ in range(20):
        base = published.current(spark, path)
        known = _known(spark, path, parser, base)
        new = addresses if known is None else addresses.join(known.select("digest"), "digest", "left_anti")
        n = new.count()
        if n:
            rows = parse(new, "address", "region", postcode_mode).select("digest", "region", F.lit(parser).alias("parser"))
            try:
                published.append(rows, path, base=base, partition_by=["parser"])
            except published.Conflict:
                continue
        published.delete_path(spark, distinct)
        return n
    raise published.Conflict(f"{path} is extended by others all the time")


def regions_by_dictionary(df: DataFrame, column: str, out: str = "uk_region", path: str | None = None,
                          postcode_mode: str = "reference", listed: bool = False) -> DataFrame:
    """``df`` with the region of each row's address (null, empty: Unknown), of which no row is parsed. Two
    addresses of one digest can't differ in practice (256 bits). The join is Spark's to choose, by the dictionary's size."""
    spark = df.sparkSession
    path, parser = path or default_path(spark), parser_name(postcode_mode, listed)
    learn_addresses(df, column, path, postcode_mode, listed)
    known = _known(spark, path, parser, published.current(spark, path))
    if known is None:
        return df.withColumn(out, F.lit(UNKNOWN))
    found = known.select(F.col("digest").alias("_digest"), F.col("region").alias(out))
    digest = F.when(F.col(column) != "", _digest(F.col(column)))
    rows = df.drop(out).withColumn("_digest", digest).join(found, "_digest", "left").drop("_digest")
    return rows.withColumn(out, F.coalesce(F.col(out), F.lit(UNKNOWN)))


def add_region_column(df: DataFrame, postcode_mode: str = "reference", path: str | None = None) -> DataFrame:
    """``operators.regions.add_region_column`` by the dictionary: the export's list ``location_full`` if
    there is one, else the raw ``regions`` address, else Unknown."""
    if "location_full" in df.columns:
        return regions_by_dictionary(df, "location_full", path=path, postcode_mode=postcode_mode, listed=True)
    if "regions" in df.columns:
        return regions_by_dictionary(df, "regions", path=path, postcode_mode=postcode_mode)
    return df.withColumn("uk_region", F.lit(UNKNOWN))
