"""Session construction and the shared work folder.

Everything in the library is lazy DataFrame code; this module only decides the session
settings the semantics depend on (UTC, ANSI) and the ones scale depends on (AQE, skew join).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every caller needs for correct results.
SEMANTIC_CONF = {
    # naive timestamps are interpreted as UTC wall time
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Settings for throughput at scale; they never change results.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "vacancy_spark",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: AQE coalesces the
    shuffle partitions at run time. Locally, pass ``local[N]`` and ``N`` partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**SEMANTIC_CONF, **SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    apply_semantic_conf(spark)
    return spark


def cluster_settings(input_bytes: int, executor_cores: int = 4, executor_memory_gb: float = 16.0,
                     target_partition_bytes: int = 256 << 20) -> dict:
    """Partition sizing for a cluster run over ``input_bytes`` of event data.

    Scan splits and shuffle partitions are sized to ``target_partition_bytes`` (capped so
    that one partition per core fits in a quarter of the executor's memory); AQE then
    coalesces small shuffle partitions and splits skewed ones around the same advisory size.
    Most shuffles here follow a partial aggregate and are far smaller than the input, but a
    full-width one keeps its partitions at the target too. E.g. 100 TB at 256 MB -> 372,530.
    """
    per_core = executor_memory_gb * (1 << 30) / max(executor_cores, 1) / 4
    size = int(max(32 << 20, min(target_partition_bytes, per_core)))
    parts = max(200, -(-int(input_bytes) // size))
    return {
        "spark.sql.files.maxPartitionBytes": str(size),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(size),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * size),
    }


def apply_semantic_conf(spark: SparkSession) -> None:
    """Force the result-relevant settings on an existing session (e.g. the driver's)."""
    for k, v in SEMANTIC_CONF.items():
        spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    Written tables and checkpoints go here. Without the setting, a session whose master is
    ``local`` (unit tests, a laptop) gets a local folder; on a cluster that is an error, since
    no other machine would see it.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vacancy-spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)  # DataFrame.checkpoint() writes under the same folder
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused location under the shared folder (one per write)."""
    return f"{shared_dir(spark)}/vacancy_spark/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for the few helpers that list a local folder."""
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path) if not path.startswith("/") else path
