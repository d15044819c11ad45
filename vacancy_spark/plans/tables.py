"""Rebuild, partition, backfill and snapshot the tables behind the reports.

These are job steps, so they write (and sometimes check) data. Rules kept throughout:

* writes go to the location the caller names (on a cluster: under ``spark.checkpoint.dir``
  or a table path), never to a machine-local temp folder;
* a table is replaced by writing beside it and swapping the folders (``replace_path``), so a
  failed job leaves the old table intact and a path being read is never overwritten by the
  plan that reads it;
* partitioned writes are laid out by a REBALANCE shuffle on the partition column (AQE splits
  an oversized day -- one hot vacancy included -- over several tasks) and sorted within each
  task on the cluster keys, so every task writes few folders of well-clustered files.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_yyyymmdd
from ..schema import CSV_DIALECT, CSV_READ, RANGE_START, RANGE_STEP, RANGE_STOP, TYPED_REBUILD_EXCLUDED
from ..sources.ranges import RangePartitions
from . import published

# Rows per output file: bounds file size at any scale.
MAX_RECORDS_PER_FILE = 5_000_000


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_path(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Run ``write`` into a staged sibling folder, then swap it in place of ``path``.

    A job that fails (or loses executors beyond retry) leaves the old table untouched. The swap
    is two renames and not atomic: for a moment there is no table under ``path``, and on an
    object store a rename is a copy. Each is checked; if the new folder can't be put in place,
    the old one is put back and the call fails.
    """
    tag = uuid.uuid4().hex[:12]
    staged = f"{path}._staged-{tag}"
    write(staged)
    target, fs = _fs(spark, path)
    new, _ = _fs(spark, staged)
    old, _ = _fs(spark, f"{path}._old-{tag}")
    had = fs.exists(target)
    if had:
        _rename(fs, target, old)
    try:
        if fs.exists(target):  # a rename onto a folder would put the new one inside it
            raise OSError(f"{path} was written by someone else meanwhile")
        _rename(fs, new, target)
    except Exception:
        if had and not fs.exists(target):
            _rename(fs, old, target)
        raise
    if had:
        fs.delete(old, True)
    return path


def _rename(fs, src, dst) -> None:
    if not fs.rename(src, dst):
        raise OSError(f"cannot rename {src} to {dst}")


def _clustered(df: DataFrame, partition_cols: list[str], sort_cols: list[str]) -> DataFrame:
    """Lay rows out for a partitioned write: a REBALANCE shuffle on the partition columns
    (AQE splits an oversized day -- e.g. one holding a hot vacancy -- into several tasks and
    merges tiny ones, without a sampling pass), then a sort within each task on the cluster
    keys, so each file covers a narrow key range and Parquet min/max statistics skip row
    groups."""
    return df.hint("rebalance", *partition_cols).sortWithinPartitions(*sort_cols)


def typed_events(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Raw events -> typed events: string vacancy key, parsed event date (strict parse fails
    the job on a bad date), originals kept, excluded columns dropped."""
    keep = [c for c in raw.columns if c not in TYPED_REBUILD_EXCLUDED
            and c not in ("entity_id", "event_date")]
    return raw.select(
        F.col("entity_id").cast("string").alias("entity_id_str"),
        parse_yyyymmdd("event_date", strict=strict).alias("event_date_parsed"),
        F.col("event_date").alias("event_date_original"),
        F.col("entity_id").alias("entity_id_original"),
        *keep,
    )


def rebuild_typed_events(raw: DataFrame, path: str, strict: bool = True) -> DataFrame:
    """CTAS equivalent: typed events, partitioned by day, clustered by (vacancy, day)."""
    t = typed_events(raw, strict)
    laid = _clustered(t, ["event_date_parsed"], ["event_date_parsed", "entity_id_str"])
    replace_path(t.sparkSession, path, lambda out: (
        laid.write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
            .partitionBy("event_date_parsed").parquet(out)))
    return t.sparkSession.read.parquet(path)


def range_bucket(c, start: int, stop: int, step: int):
    """Integer-range partition of ``c``: boundaries start, start+step, ... <= stop; bucket i
    holds [b_i, b_i+1). Below the first or at/after the last boundary -> -1; null -> null."""
    return RangePartitions("", start, stop, step).of(F.col(c) if isinstance(c, str) else c)


def rebuild_range_partitioned(raw: DataFrame, path: str, start: int = RANGE_START,
                              stop: int = RANGE_STOP, step: int = RANGE_STEP,
                              date_col: str = "event_date", entity: str = "entity_id") -> DataFrame:
    """Copy of ``raw`` partitioned by integer-date buckets (yearly by default), clustered by (date,
    vacancy). The ranges are written beside the data, for the scan to prune by."""
    ranges = RangePartitions(date_col, start, stop, step)
    ev = F.col(date_col).cast("string").try_cast("bigint")
    t = raw.withColumn(ranges.bucket, ranges.of(ev))
    laid = _clustered(t, [ranges.bucket], [ranges.bucket, date_col, entity])

    def write(out: str) -> None:
        (laid.write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy(ranges.bucket).parquet(out))
        ranges.write(raw.sparkSession, out)

    replace_path(raw.sparkSession, path, write)
    return raw.sparkSession.read.schema(t.schema).parquet(path)


def overwrite_table(spark: SparkSession, df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Replace the table's rows with ``df`` while keeping its existing columns (added columns
    allowed, old ones kept as nulls), then verify the row count.

    The old schema comes from the manifest (of a plain folder: the files' footers); the old rows are
    never part of the plan. The new version is published by manifest (``plans.published``).
    """
    published.replace(df, path, keep_columns=True)
    back = published.open_table(spark, path)
    return back, back.count()


def add_columns(df: DataFrame, columns: dict) -> DataFrame:
    """Add typed, all-null columns (``ALTER TABLE ADD COLUMNS`` on a DataFrame)."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns})


def merge_update(target: DataFrame, source: DataFrame, on: str, cols) -> DataFrame:
    """``MERGE ... WHEN MATCHED THEN UPDATE SET cols`` as a join: matched target rows take the
    source values (even nulls), unmatched rows keep theirs. Several source rows for one
    matched key fail the job, as a MERGE does.

    The source is first reduced to one row per key (partial aggregate), so the join never
    fans out; the result is a new DataFrame to be written to a fresh path. ``published.merge_into``
    updates a stored table and rewrites only the partitions or files that hold a matched key.
    """
    cols = list(cols)
    return published.updated(target, published.reduced(source, on, cols), on, cols)


def backup_name(base: str, as_of) -> str:
    """``<base>_backup_yyyy-MM-dd_HHmm``."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    return f"{base}_backup_{as_of.strftime('%Y-%m-%d_%H%M')}"


def _folder_backups(spark: SparkSession, folder: str, base: str) -> list[str]:
    """Backups that are folders of their own (as earlier versions of this library wrote them): the whole
    name must be a backup's, so what a dead writer left beside them is none."""
    p, fs = _fs(spark, folder)
    if not fs.exists(p):
        return []
    form = re.compile(re.escape(base) + r"_backup_\d{4}-\d{2}-\d{2}_\d{4}")
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return [n for n in names if form.fullmatch(n)]


def list_backups(spark: SparkSession, folder: str, base: str) -> list[str]:
    """Backup names of ``base``, newest first (names sort by their timestamp)."""
    m = published.current(spark, f"{folder}/{base}")
    return sorted({*(m.backups if m else ()), *_folder_backups(spark, folder, base)}, reverse=True)


def open_backup(spark: SparkSession, folder: str, base: str, name: str) -> DataFrame:
    m = published.current(spark, f"{folder}/{base}")
    if m and name in m.backups:
        return published.open_table(spark, f"{folder}/{base}", backup=name)
    return spark.read.parquet(f"{folder}/{name}")


def snapshot_table(spark: SparkSession, df: DataFrame, folder: str, base: str, as_of,
                   keep: int = 3, archive_source: DataFrame | None = None,
                   keep_archives: int = 3) -> dict:
    """Publish ``df`` as ``folder/base``, and the same version under a timestamped backup name, of which
    the newest ``keep`` stay. With ``archive_source`` the extract variant also archives the
    source (as backups of ``<base>_source``) and keeps ``keep_archives`` archives.

    The rows are written once: table and backup are one data folder, named by the manifest, which
    also is what retention goes by. Returns the folder written (``current``, ``backup``; readers that want the
    newest version use ``published.open_table``) and the names of the backups that are no longer kept.
    """
    current, removed = _snapshot(spark, df, folder, base, as_of, keep)
    out = {"current": current, "backup": current, "removed": removed}
    if archive_source is not None:
        out["archive"], gone = _snapshot(spark, archive_source, folder, f"{base}_source", as_of, keep_archives)
        out["removed"] = removed + gone
    return out


def _snapshot(spark: SparkSession, df: DataFrame, folder: str, base: str, as_of, keep: int) -> tuple[str, list[str]]:
    table, name = f"{folder}/{base}", backup_name(base, as_of)
    before = list_backups(spark, folder, base)
    kept = sorted({*before, name}, reverse=True)[:keep]
    own, fs = _fs(spark, f"{table}/{name}")
    data = name if not fs.exists(own) else f"{name}-{uuid.uuid4().hex[:12]}"
    published.replace(df, table, backup=name, keep=keep, folder=data)
    for n in _folder_backups(spark, folder, base):
        if n not in kept:
            published.delete_path(spark, f"{folder}/{n}")
    published.vacuum(spark, table)
    return f"{table}/{data}", [n for n in before if n not in kept]


def export_name(prefix: str, as_of, with_time: bool = False) -> str:
    """Report file names stamped with the run time: ``<prefix>_YYYYMMDD`` or, for vacancy
    reports, ``<prefix>_YYYYMMDD_HHMMSS`` (then ``.csv``)."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    return f"{prefix}_{as_of.strftime('%Y%m%d_%H%M%S' if with_time else '%Y%m%d')}.csv"


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Header CSV without an index column; one file only when asked (that funnels all rows
    through one task, so only for small reports)."""
    out = df.coalesce(1) if single_file else df
    replace_path(df.sparkSession, path, lambda staged: (
        out.write.options(**CSV_DIALECT).csv(staged)))
    return path


def read_csv_like(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read back an exported CSV with the schema it was written from."""
    return spark.read.options(**CSV_READ).schema(schema).csv(path)
