"""File and catalog sources.

CSV is read as text by ``csv_ranges``: in byte ranges, columns bound by name file by file, a record with
too many fields an error. Types are inferred only for the load that infers them (A7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean_importer_mapping, dedup_latest, normalise_metadata
from ..schema import IMPORTER_MAPPING_SCHEMA, JOB_EXPORT_SCHEMA, JOB_METADATA_SCHEMA
from ..session import fresh_path
from .csv_ranges import read_csv
from .infer import infer_schema, typed

POSITION = "_position"


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` (or something that matches it) exists on its (possibly remote) file system."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath)) or any(c in path for c in "*?[{") and bool(fs.globStatus(hpath))


def path_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(hpath).getLength())


def read_text_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Every column of header CSV files as text (options: those of ``csv_ranges.read_csv``)."""
    return read_csv(spark, path, **options)


def read_job_export(spark: SparkSession, path: str, columns=None, position: bool = False,
                    bad_rows: str = "fail") -> DataFrame:
    """The job export CSV (header row, all text), bound by column name, file by file: the known
    columns first, null where the files lack one, then any others they have. Missing file -> empty
    frame of the known columns. ``columns`` keeps only those columns (the column-pruned variant).

    ``position`` adds ``_position``, which orders rows as the files do: by file name, then by
    place in the file. ``bad_rows``: see ``csv_ranges.read_csv``.
    """
    if path_exists(spark, path):
        raw = read_text_csv(spark, path, position=POSITION if position else None, bad_rows=bad_rows)
        known = [f.name for f in JOB_EXPORT_SCHEMA.fields]
        df = raw.select(*[F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c)
                          for c in known], *[F.col(f"`{c}`") for c in raw.columns if c not in known])
    else:
        df = spark.createDataFrame([], JOB_EXPORT_SCHEMA)
        if position:
            df = df.withColumn(POSITION, F.lit(None).cast("struct<file:string,block:bigint,row:bigint>"))
    if columns:
        df = df.select(*[c for c in (*columns, *([POSITION] if position else [])) if c in df.columns])
    return df


def load_metadata(spark: SparkSession, path: str, as_of, null_fill: str | None = "",
                  dates: str = "dmy") -> DataFrame:
    """The job export file as metadata rows: of rows that repeat an id, the last in file order."""
    rows = normalise_metadata(read_job_export(spark, path, position=True), as_of, null_fill, dates)
    return dedup_latest(rows, "entity_id", POSITION).drop(POSITION)


def read_importer_mapping(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """importer id -> name CSV. A UTF-8 byte-order mark is tolerated; blank ids are dropped, both fields stripped, the last row per id wins."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], IMPORTER_MAPPING_SCHEMA)
    raw = read_text_csv(spark, path)
    missing = {"importer_id", "importer_name"} - set(raw.columns)
    if missing:
        return spark.createDataFrame([], IMPORTER_MAPPING_SCHEMA)
    return clean_importer_mapping(raw, strip=strip)


def read_all_string(spark: SparkSession, path: str) -> DataFrame:
    """A header-row table read entirely as strings (the sheet export). Empty -> error."""
    df = read_text_csv(spark, path)
    if not df.columns:
        raise ValueError(f"no header row in {path}")
    return df


def register_external_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """An external (file-backed) table over header CSV files, visible to SQL as ``name``."""
    read_text_csv(spark, path).createOrReplaceTempView(name)
    return spark.table(name)


def load_csv_replace(spark: SparkSession, path: str, dest: str,
                     schema=None) -> tuple[DataFrame, dict]:
    """Load CSV files with inferred types (or the given ``schema``, by column name) and fully
    replace the published table ``dest`` (``plans.published``).

    Validates that the file exists and has at least one row; returns the loaded table and
    its stats (rows, bytes on disk, columns). This is a job step, so it runs actions. The text is
    written once as Parquet; types are found by one aggregate over that, and cast from it. A value
    that does not have the type given for its column fails the load, with the old table in place.
    """
    from ..plans import published
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    staged = fresh_path(spark, "csv-text")
    raw = read_text_csv(spark, path)
    raw.write.parquet(staged)
    text = spark.read.schema(raw.schema).parquet(staged)
    if not raw.columns or text.isEmpty():
        raise ValueError(f"{path} has no rows")
    out = typed(text, schema if schema is not None else infer_schema(text))
    published.replace(out, dest)
    loaded = published.open_table(spark, dest)
    stats = {"rows": loaded.count(), "bytes": published.table_bytes(spark, dest), "columns": len(loaded.columns)}
    published.delete_path(spark, staged)
    return loaded, stats


def create_metadata_table(spark: SparkSession, name: str, location: str) -> DataFrame:
    """``CREATE TABLE IF NOT EXISTS`` with the metadata schema, stored as Parquet at
    ``location``. The key's NOT NULL is enforced on write by ``write_metadata``."""
    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}"
                     for f in JOB_METADATA_SCHEMA.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet LOCATION '{location}'")
    return spark.table(name)


def table_location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE FORMATTED {name}").collect()
    return next(r["data_type"] for r in rows if r["col_name"] == "Location")


def write_metadata(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    """Write rows into the metadata table; a null key fails the job (no silent drop).

    ``overwrite`` (the truncating load) writes the new files beside the table's folder and
    swaps them in, so a failed load leaves the previous metadata in place; ``append`` inserts.
    """
    key = F.col("entity_id")
    checked = df.withColumn(
        "entity_id", F.when(key.isNull(), F.raise_error(F.lit("entity_id must not be null")))
                      .otherwise(key)).select(*[f.name for f in JOB_METADATA_SCHEMA.fields])
    spark = df.sparkSession
    if mode != "overwrite":
        checked.write.insertInto(name, overwrite=False)
        return
    from ..plans.tables import replace_path
    replace_path(spark, table_location(spark, name), lambda staged: checked.write.parquet(staged))
    spark.catalog.refreshTable(name)
