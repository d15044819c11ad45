"""Tables published by manifest.

A published table is a folder with immutable data folders and numbered manifests::

    <path>/_manifests/v0000000007.json     which files make up version 7, its schema, its backups
    <path>/data-<id>/[<column>=<value>/]part-*.parquet

A writer puts its rows into a new data folder, writes the next manifest aside and renames it to its
number; that rename is the one step that publishes, and it fails if another writer took the number
first. A reader resolves the newest complete manifest once and reads what it names, so it sees one
whole version however often the table is replaced meanwhile. A writer that dies leaves a data folder that no
manifest names: never read, never counted as a backup, deleted by ``vacuum`` once it is old.

A version may take some partitions (or files) from older data folders and others from newer ones:
``replace_partitions``, ``append`` and ``merge_into`` write only what changes. Backups are named
versions inside the manifest; they share the data folders, so a snapshot writes its rows once.

A plain Parquet folder becomes a published table at the first write: its files move into a data folder
(version 1), so that a plain reader of the path gets an error from then on, not old rows.

A rename that refuses an existing target is one atomic step on HDFS. On stores that copy instead (and on
a local folder) two writers at the same moment may both think that they published; readers still see
one whole version. A manifest that does not end as written is passed over.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace as changed

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFESTS = "_manifests"
MAX_PARTS = 16  # data folders that one version is read from before they are written together
KEEP_VERSIONS = 10  # newest manifests that ``vacuum`` keeps
GRACE_HOURS = 24.0  # what is younger may belong to a reader or writer at work
MAX_RECORDS_PER_FILE = 5_000_000


class Conflict(RuntimeError):
    """Another writer published a version meanwhile."""


@dataclass(frozen=True)
class Part:
    """Rows of one data folder: all of it, or the partitions or files named (relative to it)."""

    folder: str
    only: list[str] | None = None


@dataclass(frozen=True)
class Backup:
    schema: str
    parts: list[Part]


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str  # JSON of the whole schema
    partition_by: list[str]
    parts: list[Part]
    backups: dict[str, Backup] = field(default_factory=dict)  # by name
    properties: dict = field(default_factory=dict)

    @property
    def struct(self) -> T.StructType:
        return _struct(self.schema)

    def folders(self) -> set[str]:
        return {p.folder for p in [*self.parts, *(p for b in self.backups.values() for p in b.parts)]}


def _struct(schema: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(schema))


# -- files ---------------------------------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list:
    p, fs = _fs(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def delete_path(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def _file(path: str, version: int) -> str:
    return f"{path}/{MANIFESTS}/v{version:010d}.json"


def _versions(spark: SparkSession, path: str) -> list[int]:
    names = [s.getPath().getName() for s in _listed(spark, f"{path}/{MANIFESTS}")]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())


def read_manifest(spark: SparkSession, path: str, version: int) -> Manifest | None:
    """A version's manifest; None if it is not there or not complete."""
    p, fs = _fs(spark, _file(path, version))
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    if not text.endswith("}\n"):
        return None
    raw = json.loads(text)
    parts = lambda rows: [Part(**p) for p in rows]
    return Manifest(**{**raw, "parts": parts(raw["parts"]),
                       "backups": {n: Backup(b["schema"], parts(b["parts"])) for n, b in raw["backups"].items()}})


def current(spark: SparkSession, path: str) -> Manifest | None:
    """The newest complete manifest; None for a plain folder or none at all."""
    for v in reversed(_versions(spark, path)):
        found = read_manifest(spark, path, v)
        if found:
            return found
    return None


def _create(spark: SparkSession, path: str, m: Manifest) -> None:
    """The publishing step: the manifest is written aside and renamed to its number, unless that is taken."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, _ = _fs(spark, _file(path, m.version))
    aside, fs = _fs(spark, f"{path}/{MANIFESTS}/_new-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray((json.dumps(asdict(m)) + "\n").encode()))
    out.close()
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(
            fs.makeQualified(aside), fs.makeQualified(target), plain)
    except Exception as e:
        fs.delete(aside, False)
        if fs.exists(target):
            raise Conflict(f"version {m.version} of {path} was published by another writer") from e
        raise


# -- reading ---------------------------------------------------------------------------------------

def _frame(spark: SparkSession, path: str, struct: T.StructType, parts: list[Part]) -> DataFrame:
    frames = []
    for part in parts:
        root = f"{path}/{part.folder}"
        reader = spark.read.schema(struct).option("basePath", root)
        if part.only is None:
            frames.append(reader.parquet(root))
        elif part.only:
            frames.append(reader.parquet(*[f"{root}/{x}" for x in part.only]))
    if not frames:
        return spark.createDataFrame([], struct)
    names = struct.names
    out = frames[0].select(*[F.col(f"`{n}`") for n in names])
    for f in frames[1:]:
        out = out.unionByName(f.select(*[F.col(f"`{n}`") for n in names]))
    return out


def open_table(spark: SparkSession, path: str, version: int | None = None, backup: str | None = None) -> DataFrame:
    """The table's newest version, an older one, or a backup. A plain Parquet folder is read as it is."""
    m = current(spark, path) if version is None else read_manifest(spark, path, version)
    if m is None:
        if version is not None or backup is not None:
            raise LookupError(f"{path} has no such version")
        return spark.read.parquet(path)
    if backup is not None and backup not in m.backups:
        raise LookupError(f"{path} has no backup {backup}")
    chosen = m if backup is None else m.backups[backup]
    return _frame(spark, path, _struct(chosen.schema), chosen.parts)


def part_paths(path: str, parts: list[Part]) -> list[str]:
    return [f"{path}/{p.folder}" + (f"/{x}" if x else "") for p in parts for x in (p.only if p.only is not None else [""])]


def table_bytes(spark: SparkSession, path: str) -> int:
    """Size of the newest version's files."""
    total = 0
    for place in part_paths(path, current(spark, path).parts):
        p, fs = _fs(spark, place)
        total += int(fs.getContentSummary(p).getLength())
    return total


# -- writing ---------------------------------------------------------------------------------------

def _write(df: DataFrame, path: str, partition_by: list[str], sort_by: list[str], folder: str | None = None) -> str:
    folder = folder or f"data-{uuid.uuid4().hex[:12]}"
    if partition_by:
        df = df.hint("rebalance", *partition_by).sortWithinPartitions(*partition_by, *sort_by)
    out = df.write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(f"{path}/{folder}")
    return folder


def _adopted(spark: SparkSession, path: str) -> Manifest | None:
    """The current manifest. A plain Parquet folder is made version 1 first."""
    m = current(spark, path)
    if m is not None:
        return m
    inside = [s.getPath().getName() for s in _listed(spark, path)]
    rows = [n for n in inside if not n.startswith(("_", ".", "data-"))]
    if not rows:
        return None
    df = spark.read.parquet(path)
    partition_by = _partition_columns(spark, path)
    folder = f"data-{uuid.uuid4().hex[:12]}"
    target, fs = _fs(spark, f"{path}/{folder}")
    fs.mkdirs(target)
    for n in rows:
        old, _ = _fs(spark, f"{path}/{n}")
        new, _ = _fs(spark, f"{path}/{folder}/{n}")
        if not fs.rename(old, new):
            raise OSError(f"cannot move {old}")
    m = Manifest(1, df.schema.json(), partition_by, [Part(folder)])
    _create(spark, path, m)
    return m


def _partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Names of the nested partition folders, from the outermost down."""
    out, at = [], path
    while True:
        inside = [s.getPath().getName() for s in _listed(spark, at) if s.isDirectory() and "=" in s.getPath().getName()]
        if not inside:
            return out
        out.append(inside[0].split("=", 1)[0])
        at = f"{at}/{inside[0]}"


def replace(df: DataFrame, path: str, partition_by: list[str] = (), sort_by: list[str] = (),
            properties: dict | None = None, backup: str | None = None, keep: int | None = None,
            keep_columns: bool = False, folder: str | None = None) -> Manifest:
    """Publish ``df`` as the table's whole content.

    ``backup`` also names the new version as a backup, of which the newest ``keep`` (by name) stay.
    ``keep_columns``: columns of the old version that ``df`` lacks stay, as nulls. Of two writers that
    replace at the same time the later one to publish wins; both versions were whole.
    """
    spark = df.sparkSession
    base = _adopted(spark, path)
    if keep_columns and base is not None:
        df = spark.createDataFrame([], base.struct).unionByName(df, allowMissingColumns=True)
    folder = _write(df, path, list(partition_by), list(sort_by), folder)
    for _ in range(100):
        backups = dict(base.backups) if base else {}
        if backup is not None:
            backups[backup] = Backup(df.schema.json(), [Part(folder)])
        if keep is not None:
            backups = {n: backups[n] for n in sorted(backups, reverse=True)[:keep]}
        m = Manifest((base.version if base else 0) + 1, df.schema.json(), list(partition_by), [Part(folder)], backups,
                     properties if properties is not None else (base.properties if base else {}))
        try:
            _create(spark, path, m)
            return m
        except Conflict:
            base = current(spark, path)
    raise Conflict(f"{path} is published by others all the time")


def folders_of(spark: SparkSession, path: str, part: Part, depth: int) -> list[str]:
    """The partitions (``depth`` levels of folders) or, with depth 0, the files of a part."""
    if part.only is not None:
        return part.only
    found = [""]
    for level in range(max(1, depth)):
        found = [f"{a}/{n}".lstrip("/") for a in found
                 for n in (s.getPath().getName() for s in _listed(spark, f"{path}/{part.folder}/{a}"))
                 if not n.startswith(("_", "."))]
    return found


def _next(spark: SparkSession, path: str, base: Manifest, parts: list[Part], **other) -> Manifest:
    m = changed(base, version=base.version + 1, parts=[p for p in parts if p.only is None or p.only], **other)
    _create(spark, path, m)
    return m


def append(df: DataFrame, path: str, base: Manifest | None = None, **first) -> Manifest:
    """Publish the table with the rows of ``df`` added, in a data folder of their own (``first``: options
    of ``replace``, for a table that is not there yet). Raises ``Conflict`` if another writer published
    meanwhile: since ``base``, the version that ``df`` was made from, if given."""
    spark = df.sparkSession
    base = base or _adopted(spark, path)
    if base is None:
        return replace(df, path, **first)
    rows = df.select(*[F.col(f"`{n}`") for n in base.struct.names])
    folder = _write(rows, path, base.partition_by, list(first.get("sort_by", ())))
    return _compacted(spark, path, _next(spark, path, base, [*base.parts, Part(folder)]))


def replace_partitions(df: DataFrame, path: str, sort_by: list[str] = (), only: list[str] | None = None,
                       properties: dict | None = None) -> Manifest:
    """Publish the table with the partitions that ``df`` has rows of (and those of ``only``, by folder
    name) replaced by these rows; all others keep their files."""
    spark = df.sparkSession
    base = _adopted(spark, path)
    if base is None or not base.partition_by:
        raise ValueError(f"{path} is not a partitioned published table")
    folder = _write(df.select(*[F.col(f"`{n}`") for n in base.struct.names]), path, base.partition_by, list(sort_by))
    depth = len(base.partition_by)
    gone = {*folders_of(spark, path, Part(folder), depth), *(only or ())}
    m = _next(spark, path, base, [*_without(spark, path, base, gone), Part(folder)],
              **({} if properties is None else {"properties": properties}))
    return _compacted(spark, path, m)


def _without(spark: SparkSession, path: str, base: Manifest, gone: set[str]) -> list[Part]:
    """The version's parts without the partitions (or files) ``gone``."""
    out = []
    for part in base.parts:
        inside = folders_of(spark, path, part, len(base.partition_by))
        kept = [x for x in inside if x not in gone]
        out.append(part if len(kept) == len(inside) else Part(part.folder, kept))
    return [p for p in out if p.only is None or p.only]


def reduced(source: DataFrame, on: str, cols: list[str]) -> DataFrame:
    """One row for each key: how many rows it has, and the values of one of them."""
    return source.where(F.col(on).isNotNull()).groupBy(on).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c, ignorenulls=False).alias(f"_src_{c}") for c in cols])


def updated(target: DataFrame, source: DataFrame, on: str, cols: list[str]) -> DataFrame:
    """``target`` with the values of ``reduced`` rows of the same key; several rows for a matched key fail."""
    kinds = target.schema
    j = target.join(source.withColumn("_matched", F.lit(True)), on, "left")
    matched = F.coalesce(F.col("_matched"), F.lit(False))
    dup = F.raise_error(F.lit("MERGE: several source rows match one target row"))
    return j.withColumns({c: F.when(matched & (F.col("_n") > 1), dup.cast(kinds[c].dataType))
                          .when(matched, F.col(f"_src_{c}").cast(kinds[c].dataType)).otherwise(F.col(c))
                          for c in cols}).select(*target.columns)


def merge_into(spark: SparkSession, path: str, source: DataFrame, on: str, cols: list[str]) -> tuple[Manifest, list[str]]:
    """``MERGE ... WHEN MATCHED THEN UPDATE SET cols`` into a published table.

    First the keys alone are joined, to find the partitions (without any: the files) that hold a matched
    key; only those are read in full, updated and written; the others keep their files. Returns the new
    manifest (the old one, if nothing matches) and the partitions or files that were rewritten.
    """
    base = _adopted(spark, path)
    if base is None:
        raise LookupError(f"no table under {path}")
    cols = list(cols)
    if set(cols) & {*base.partition_by, on}:
        raise ValueError("neither the key nor a partition column can be updated")
    from ..session import fresh_path
    keys = fresh_path(spark, "merge-source")  # written, so that both joins know its real size
    rows = reduced(source, on, cols)
    rows.write.parquet(keys)
    rows = spark.read.schema(rows.schema).parquet(keys)
    touched: dict[str, set[str]] = {}
    for part in base.parts:
        hits = (_frame_with_file(spark, path, base, part, on).join(rows.select(on), on, "left_semi")
                .groupBy("_place").count().collect())  # a row for each partition or file
        if hits:
            touched[part.folder] = {r["_place"] for r in hits}
    if not touched:
        delete_path(spark, keys)
        return base, []
    hit = [Part(f, sorted(places)) for f, places in touched.items()]
    folder = _write(updated(_frame(spark, path, base.struct, hit), rows, on, cols), path, base.partition_by, [])
    parts = []
    for part in base.parts:
        places = touched.get(part.folder, set())
        inside = folders_of(spark, path, part, len(base.partition_by)) if places else None
        kept = None if inside is None else [x for x in inside if x not in places]
        parts.append(part if kept is None else Part(part.folder, kept))
    m = _next(spark, path, base, [*parts, Part(folder)])
    delete_path(spark, keys)
    return _compacted(spark, path, m), sorted(x for places in touched.values() for x in places)


def _frame_with_file(spark: SparkSession, path: str, m: Manifest, part: Part, on: str) -> DataFrame:
    """The key column and each row's partition folder (or file), relative to the data folder."""
    root = f"{path}/{part.folder}"
    reader = spark.read.schema(m.struct).option("basePath", root)
    df = reader.parquet(root) if part.only is None else reader.parquet(*[f"{root}/{x}" for x in part.only])
    inside = F.substring_index(F.col("_metadata.file_path"), f"/{part.folder}/", -1)
    place: Column = F.regexp_replace(inside, "/[^/]*$", "") if m.partition_by else inside
    return df.select(F.col(f"`{on}`"), F.url_decode(F.replace(place, F.lit("+"), F.lit("%2B"))).alias("_place"))


def _compacted(spark: SparkSession, path: str, m: Manifest) -> Manifest:
    """Beyond MAX_PARTS data folders, all but the largest are written together."""
    if len(m.parts) <= MAX_PARTS:
        return m
    def size(part: Part) -> int:
        return sum(int(fs.getContentSummary(p).getLength()) for p, fs in (_fs(spark, x) for x in part_paths(path, [part])))
    largest = max(m.parts, key=size)
    rest = [p for p in m.parts if p is not largest]
    folder = _write(_frame(spark, path, m.struct, rest), path, m.partition_by, [])
    try:
        return _next(spark, path, m, [largest, Part(folder)])
    except Conflict:
        return m  # published all the same; the next write tries again


# -- upkeep ------------------------------------------------------------------------------------------

def vacuum(spark: SparkSession, path: str, keep_versions: int = KEEP_VERSIONS, grace_hours: float = GRACE_HOURS) -> list[str]:
    """Delete manifests but the newest ``keep_versions``, and data folders that no manifest left names
    (unless younger than ``grace_hours``: someone may be writing or reading them). Returns what was deleted."""
    versions = _versions(spark, path)
    if not versions:
        return []
    old_before = (time.time() - grace_hours * 3600) * 1000
    named: set[str] = set()
    gone = []
    for i, v in enumerate(reversed(versions)):
        p, fs = _fs(spark, _file(path, v))
        if i >= max(1, keep_versions) and fs.getFileStatus(p).getModificationTime() <= old_before:
            fs.delete(p, False)
            gone.append(f"{MANIFESTS}/{p.getName()}")
        else:
            m = read_manifest(spark, path, v)
            named |= m.folders() if m else set()
    for s in _listed(spark, path):
        name = s.getPath().getName()
        if s.isDirectory() and name != MANIFESTS and name not in named and s.getModificationTime() <= old_before:
            delete_path(spark, f"{path}/{name}")
            gone.append(name)
    return gone
