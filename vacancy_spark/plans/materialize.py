"""Build the enriched event table once and scan it.

The reports read one fact table: the enriched, date-partitioned event table (what the
reference builds with a CTAS and then scans by date). Here it is derived from the driver
tables and written under the shared ``spark.checkpoint.dir``:

1. the per-user attributes (one row per user) are written first; reading them back gives
   Spark their real size, so the join back onto the events is a broadcast only when the
   file statistics are under ``spark.sql.autoBroadcastJoinThreshold`` and a shuffle join
   (with AQE skew splitting) otherwise -- the event table is never shuffled just to find
   out that the other side was small;
2. the events joined with their attributes are rebalanced by day (AQE splits an oversized
   day over several tasks), sorted by (day, vacancy) within each task and written
   partitioned by day, so date filters prune folders and vacancy filters skip row groups.

The folder name is a hash of the inputs' paths, sizes and modification times and of the code
that defines the table; a finished
table is reused (the input files are listed once a session), a new one is written to a temporary
name and renamed into place, and the
written table also cuts the lineage of every report built on it.
"""

from __future__ import annotations

import hashlib
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir
from ..sources import fixtures as FX
from .tables import MAX_RECORDS_PER_FILE, _clustered

SOURCES = ("events", "customer", "nation", "region", "part")

# Extra text mixed into the folder name; a benchmark sets it to force (and time) a fresh build.
CACHE_TAG = ""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _code_version() -> str:
    """Hash of the code that defines the table, so a changed binding never reuses old files."""
    h = hashlib.sha1()
    for mod in (FX, sys.modules[__name__]):
        with open(mod.__file__, "rb") as f:
            h.update(f.read())
    return h.hexdigest()


_PRINTS: dict[tuple, str] = {}


def _fingerprint(spark: SparkSession, sf_dir: str, sources=SOURCES) -> str:
    """Hash of all files under the inputs, at any depth; listed once a session (``refresh``)."""
    key = (spark.sparkContext.applicationId, CACHE_TAG, sf_dir.rstrip("/"), tuple(sources))
    if key not in _PRINTS:
        h = hashlib.sha1((CACHE_TAG + _code_version() + sf_dir.rstrip("/")).encode())
        for name in sources:
            p, fs = _fs(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
            files, found = fs.listFiles(p, True), []
            while files.hasNext():
                st = files.next()
                found.append(f"{st.getPath()}:{st.getLen()}:{st.getModificationTime()};")
            h.update("".join(sorted(found)).encode())
        _PRINTS[key] = h.hexdigest()[:16]
    return _PRINTS[key]


def refresh() -> None:
    """Look at the input files again: call it after they changed during a session."""
    _PRINTS.clear()


def _publish(spark: SparkSession, tmp: str, final: str) -> None:
    """Put the finished folder in place unless another job published the same table first."""
    src, fs = _fs(spark, tmp)
    dst, _ = _fs(spark, final)
    if not fs.exists(dst) and fs.rename(src, dst):
        inside, _ = _fs(spark, f"{final}/{src.getName()}")
        if fs.exists(inside):  # published between the two calls: ours went inside it
            fs.delete(inside, True)
        return
    fs.delete(src, True)
    if not _ready(spark, final):
        raise OSError(f"cannot publish {final}")


def _ready(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, f"{path}/_SUCCESS")
    return bool(fs.exists(p))


_OPENED: dict[tuple[str, str], DataFrame] = {}


def job_events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched event binding as a date-partitioned Parquet table (built on first use).

    The opened DataFrame is kept per application and folder, so later queries skip the
    partition discovery; a change of any input file changes the folder name.
    """
    base = f"{shared_dir(spark)}/vacancy_spark/enriched"
    final = f"{base}/{_fingerprint(spark, sf_dir)}"
    key = (spark.sparkContext.applicationId, final)
    ready = _ready(spark, final)
    if ready and key in _OPENED:
        return _OPENED[key]
    if not ready:
        tmp = f"{base}/_tmp-{uuid.uuid4().hex}"
        ev = FX.table(spark, sf_dir, "events").select("ts", "user_id", "event_type")
        FX.user_attributes(spark, sf_dir, ev).write.parquet(f"{tmp}_users")
        users = spark.read.parquet(f"{tmp}_users")
        events = FX.job_events(spark, sf_dir, attrs=users)
        (_clustered(events, ["event_date_parsed"], ["event_date_parsed", "entity_id_str"])
            .write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
            .partitionBy("event_date_parsed")
            .parquet(tmp))
        _publish(spark, tmp, final)
        p, fs = _fs(spark, f"{tmp}_users")
        fs.delete(p, True)
    _OPENED[key] = spark.read.parquet(final)
    return _OPENED[key]


EXPORT_SOURCES = ("customer", "part")


def job_export_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job export binding written once as Parquet (a stored table, as the export file and
    the metadata table are in the reference), so joins against it are planned from its real
    size: a broadcast while it is small, a shuffle join once it is not."""
    base = f"{shared_dir(spark)}/vacancy_spark/job_export"
    final = f"{base}/{_fingerprint(spark, sf_dir, EXPORT_SOURCES)}"
    key = (spark.sparkContext.applicationId, final)
    ready = _ready(spark, final)
    if ready and key in _OPENED:
        return _OPENED[key]
    if not ready:
        tmp = f"{base}/_tmp-{uuid.uuid4().hex}"
        FX.job_export(spark, sf_dir).write.parquet(tmp)
        _publish(spark, tmp, final)
    _OPENED[key] = spark.read.parquet(final)
    return _OPENED[key]
