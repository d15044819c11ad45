"""Header CSV files read by many tasks each, although quoted values may hold line feeds.

Spark's text reader cuts a file into byte ranges ("blocks") at line feeds, but only a reader that
has seen the whole file so far knows whether a line begins a record or continues a quoted value.
At a line's start there are just these two states, so a block is a function from two states to two:

1. one pass works out that function for every block (lines without a quote change nothing and are
   left out by the scan), and each file's header;
2. the functions of a file's blocks, chained in order, give the state in which each block begins
   (kept: only the stretches of blocks that begin inside a quoted value, and the block in which that
   record began);
3. a second pass cuts every block into records. A record that runs over the end of its block leaves
   one fragment in each block it touches; the fragments, and nothing else, are shuffled together.

Columns are bound by name, file by file: files of one folder may order their columns differently or
lack some. A record with more fields than its file's header fails the read or becomes a reject;
one with fewer is filled up with nulls unless ``short_rows="bad"``. An empty value, quoted or
not, is null. Quotes count at the start of a field only, and are doubled inside; a
record ends at a line feed (a carriage return before it belongs to the line's end). Empty lines
are skipped.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

MAX_SPECIAL_FILES = 200_000  # files of another header, or with values across blocks, named in every task
OPEN_END = 1 << 62

PARSED = ("file string, block long, row long, n_fields int, expected int, fields array<string>, "
          "raw string, owner long, part binary")


# -- one record -----------------------------------------------------------------------------------

def _closed(line: bytes, at: int) -> int:
    """The place after the quote that closes a value, -1 if the line does not close it."""
    while True:
        q = line.find(b'"', at)
        if q < 0 or line[q + 1:q + 2] != b'"':
            return q + 1 if q >= 0 else -1
        at = q + 2


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether a line ends inside a quoted value, given whether it begins in one."""
    at = 0
    while True:
        if not inside and line[at:at + 1] == b'"':
            inside, at = True, at + 1
        if inside:
            at = _closed(line, at)
            if at < 0:
                return True
            inside = False
        at = line.find(b",", at) + 1
        if not at:
            return False


def fields_of(record: bytes) -> tuple[list[bytes | None], bool]:
    """The values of a record, and whether its last one is closed."""
    out, at = [], 0
    if record.endswith(b"\r"):
        record = record[:-1]
    while True:
        if record[at:at + 1] == b'"':
            end = _closed(record, at + 1)
            if end < 0:
                return [*out, record[at + 1:].replace(b'""', b'"')], False
            comma = record.find(b",", end)
            rest = record[end:comma] if comma >= 0 else record[end:]
            out.append(record[at + 1:end - 1].replace(b'""', b'"') + rest or None)
        else:
            comma = record.find(b",", at)
            out.append((record[at:comma] if comma >= 0 else record[at:]) or None)
        if comma < 0:
            return out, True
        at = comma + 1


def _names(record: bytes) -> list[str]:
    """Header names: missing ones are numbered, repeated ones get ``.1``, ``.2``."""
    out: list[str] = []
    values, _ = fields_of(record.removeprefix(b"\xef\xbb\xbf"))
    for i, raw in enumerate(values):
        name = (raw or b"").decode("utf-8", "replace") or f"_c{i}"
        same, n = name, 0
        while name in out:
            n += 1
            name = f"{same}.{n}"
        out.append(name)
    return out


# -- blocks -----------------------------------------------------------------------------------------

def _lines(spark: SparkSession, path) -> DataFrame:
    m = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        m["file_path"].alias("file"), m["file_block_start"].alias("block"),
        m["file_block_length"].alias("length"), m["file_size"].alias("size"),
        F.col("value").cast("binary").alias("line"))


def _segments(batch: pa.RecordBatch):
    """(file, block, length, size, lines) of each stretch of rows of one block."""
    if not batch.num_rows:
        return
    file = batch.column(0).dictionary_encode()
    code, block = file.indices.to_numpy(), batch.column(1).to_numpy()
    cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield (file.dictionary[code[a]].as_py(), int(block[a]), batch.column(2)[a].as_py(),
               batch.column(3)[a].as_py(), batch.column(4).slice(a, b - a))


@dataclass
class _State:
    """What one pass knows of the block that it is in."""

    file: str
    block: int
    length: int
    size: int
    ends: list[bool] = field(default_factory=lambda: [False, True])  # after either state at the start
    opened: bool = False  # whether, begun inside a value, the block leaves open a record of its own
    header: list[bytes] = field(default_factory=list)
    names: list[str] | None = None

    def take_header(self, lines: pa.Array) -> None:
        for line in lines:
            line = line.as_py()
            if not self.header and not line.removesuffix(b"\r"):
                continue
            self.header.append(line)
            record = b"\n".join(self.header)
            if fields_of(record)[1]:
                self.names = _names(record)
                return

    def add(self, lines: pa.Array) -> None:
        if self.block == 0 and self.names is None:
            self.take_header(lines)
        if self.length >= self.size:
            return
        for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
            before = self.ends[1]
            self.ends = [inside_after(line, s) for s in self.ends]
            if self.ends[1] and not before:
                self.opened = True

    def row(self) -> dict:
        return {"file": self.file, "block": self.block, "length": self.length, "from_start": self.ends[0],
                "from_inside": self.ends[1], "opened": self.opened, "names": self.names}


BLOCK = ("file string, block long, length long, from_start boolean, from_inside boolean, opened boolean, "
         "names array<string>")
FILE = "file string, length long, names array<string>, owners array<long>, untils array<long>"


def _block_states(batches):
    state = None
    for b in batches:
        for file, block, length, size, lines in _segments(b):
            if state is None or (state.file, state.block) != (file, block):
                if state is not None:
                    yield pa.RecordBatch.from_pylist([state.row()], _BLOCK)
                state = _State(file, block, length, size)
            state.add(lines)
    if state is not None:
        yield pa.RecordBatch.from_pylist([state.row()], _BLOCK)


_BLOCK = pa.schema([("file", pa.string()), ("block", pa.int64()), ("length", pa.int64()), ("from_start", pa.bool_()),
                    ("from_inside", pa.bool_()), ("opened", pa.bool_()), ("names", pa.list_(pa.string()))])


def _chained(table):
    """One file's blocks in order: the stretches (owner, until) of blocks that begin inside a value."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    inside, owner, owners, untils = False, 0, [], []
    for r in rows:
        was, inside = inside, r["from_inside"] if inside else r["from_start"]
        if was and (not inside or r["opened"]):
            owners.append(owner)
            untils.append(r["block"])
        if inside and (not was or r["opened"]):
            owner = r["block"]
    if inside:
        owners.append(owner)
        untils.append(OPEN_END)
    first = rows[0]
    names = first["names"] if first["block"] == 0 else None
    return pa.table({"file": [first["file"]], "length": pa.array([first["length"]], pa.int64()),
                     "names": pa.array([names], pa.list_(pa.string())),
                     "owners": pa.array([owners], pa.list_(pa.int64())),
                     "untils": pa.array([untils], pa.list_(pa.int64()))})


@dataclass
class Layout:
    """What the first pass found out about the files of a path."""

    names: list[str]  # of all files, in order of their first use
    common: list[str]  # header of most files
    block_length: int  # at which files are cut
    headers: dict[str, list[str]]  # of files with another header
    inside: dict[str, list[tuple[int, int]]]  # (owner, until) of files with values across blocks


def csv_layout(spark: SparkSession, path) -> Layout:
    """The first pass (a job)."""
    lines = _lines(spark, path)
    quoted = (F.col("length") < F.col("size")) & F.expr("instr(cast(line AS string), '\"') > 0")
    blocks = lines.where((F.col("block") == 0) | quoted).mapInArrow(_block_states, BLOCK)
    stored = fresh_path(spark, "csv-layout")
    blocks.groupBy("file").applyInArrow(_chained, FILE).write.parquet(stored)
    found = spark.read.schema(FILE).parquet(stored)
    kinds = found.where("names IS NOT NULL").groupBy("names").agg(
        F.count("*").alias("n"), F.min("file").alias("first")).collect()
    if not kinds:
        return Layout([], [], 0, {}, {})
    kinds.sort(key=lambda r: r["first"])
    if found.where("names IS NULL AND size(untils) > 0").limit(1).count():
        raise ValueError(f"a header under {path} runs over the end of its block")
    names = list(dict.fromkeys(n for r in kinds for n in r["names"]))
    common = list(max(kinds, key=lambda r: r["n"])["names"])
    same = F.col("names") == F.array(*[F.lit(n) for n in common])
    special = found.where(~F.coalesce(same, F.lit(False)) | (F.size("owners") > 0)).limit(MAX_SPECIAL_FILES + 1).collect()
    if len(special) > MAX_SPECIAL_FILES:
        raise ValueError(f"over {MAX_SPECIAL_FILES} files have another header or values across blocks: read fewer at once, "
                         "or in larger blocks (spark.sql.files.maxPartitionBytes)")
    length = int(found.agg(F.max("length")).first()[0])
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stored)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return Layout(names, common, length,
                  {r["file"]: list(r["names"]) for r in special if r["names"] is not None and list(r["names"]) != common},
                  {r["file"]: list(zip(r["owners"], r["untils"])) for r in special if r["owners"]})


# -- records ----------------------------------------------------------------------------------------

_PARSED = pa.schema([("file", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("n_fields", pa.int32()),
                     ("expected", pa.int32()), ("fields", pa.list_(pa.string())), ("raw", pa.string()),
                     ("owner", pa.int64()), ("part", pa.binary())])


def _text(values: pa.Array) -> pa.Array:
    try:
        return values.cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        return pa.array([None if v is None else v.decode("utf-8", "replace") for v in values.to_pylist()], pa.string())


def _same(n: int, value, kind: pa.DataType) -> pa.Array:
    return pa.repeat(pa.scalar(value, kind), n)


class _Cutter:
    """Cuts blocks into records. ``owner_of``: the block in which the record began that a block begins in, or None."""

    def __init__(self, layout: Layout):
        self.layout, self.key = layout, None

    def _bound(self, names: list[str]) -> list[int] | None:
        """For each column of all files the place in this file's records (None: as they are)."""
        if names == self.layout.names:
            return None
        at = {n: i for i, n in enumerate(names)}
        return [at.get(n, -1) for n in self.layout.names]

    def _begin(self, file: str, block: int, length: int, size: int) -> None:
        cut = self.layout.block_length
        if length < size and (block % cut or length != min(cut, size - block)):
            raise RuntimeError(f"{file} is cut into other blocks than when its layout was read: read it again "
                               "(the session's partition settings changed)")
        self.key, self.file, self.block, self.split, self.at = (file, block), file, block, length < size, 0
        names = self.layout.headers.get(file, self.layout.common)
        self.expected, self.bound = len(names), self._bound(names)
        self.need_header = block == 0
        self.owner = next((o for o, until in self.layout.inside.get(file, ()) if o < block <= until), None)
        self.head = [] if self.owner is not None else None  # lines of a record from an earlier block
        self.open: list[bytes] = []  # lines of a record of this block that is not complete
        self.open_row = 0

    def _placed(self, values: list, n: int) -> list:
        if self.bound is None:
            return values
        return [values[i] if 0 <= i < n else None for i in self.bound]

    def _whole(self, rows: list[int], records: list[bytes]) -> pa.RecordBatch:
        fields, counts, raw = [], [], []
        for record in records:
            values, closed = fields_of(record)
            n = len(values) if closed else -1
            odd = n != self.expected
            raw.append(record.decode("utf-8", "replace") if odd else None)
            counts.append(n)
            fields.append([None if v is None else v.decode("utf-8", "replace") for v in self._placed(values, len(values))])
        return self._batch(np.array(rows, np.int64), pa.array(counts, pa.int32()),
                           pa.array(fields, pa.list_(pa.string())), pa.array(raw, pa.string()))

    def _batch(self, rows, counts, fields, raw) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([
            _same(n, self.file, pa.string()), _same(n, self.block, pa.int64()), pa.array(rows, pa.int64()), counts,
            _same(n, self.expected, pa.int32()), fields, raw, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
            schema=_PARSED)

    def _plain(self, rows: np.ndarray, lines: pa.Array) -> pa.RecordBatch:
        """Records of one line each, without a quote."""
        if pc.any(pc.match_substring(lines, "\r")).as_py():
            lines = pa.array([x.removesuffix(b"\r") for x in lines.to_pylist()], pa.binary())
        split = pc.split_pattern(lines, ",")
        counts = pc.list_value_length(split).cast(pa.int32())
        odd = pc.not_equal(counts, self.expected)
        raw = pc.if_else(odd, _text(lines), pa.scalar(None, pa.string()))
        if self.bound is not None:
            whole = [self._placed(v, len(v)) for v in split.to_pylist()]
            split = pa.array(whole, pa.list_(pa.binary()))
        flat = _text(split.values)
        flat = pc.if_else(pc.equal(flat, ""), pa.scalar(None, pa.string()), flat)
        return self._batch(rows, counts, pa.ListArray.from_arrays(split.offsets, flat), raw)

    def _fragment(self, owner: int, row: int, lines: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": self.file, "block": self.block, "row": row, "n_fields": None,
                                            "expected": self.expected, "fields": None, "raw": None, "owner": owner,
                                            "part": b"\n".join(lines)}], schema=_PARSED)

    def lines(self, lines: pa.Array):
        n, first = len(lines), self.at
        self.at += n
        done = 0  # lines up to here are dealt with
        whole_rows, whole = [], []
        single = np.ones(n, bool)  # records of one line without a quote
        quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist()
        for i in quoted:
            line = lines[i].as_py()
            if self.head is not None or self.open:  # the lines before it continue the open record
                single[done:i + 1] = False
                (self.head if self.head is not None else self.open).extend(lines.slice(done, i + 1 - done).to_pylist())
                if not inside_after(line, True):
                    if self.head is not None:
                        yield self._fragment(self.owner, -1, self.head)
                        self.head = None
                    else:
                        whole_rows.append(self.open_row)
                        whole.append(b"\n".join(self.open))
                        self.open = []
            else:
                single[i] = False
                if inside_after(line, False):
                    self.open, self.open_row = [line], first + i
                else:
                    whole_rows.append(first + i)
                    whole.append(line)
            done = i + 1
        if self.head is not None or self.open:
            single[done:] = False
            (self.head if self.head is not None else self.open).extend(lines.slice(done).to_pylist())
        size = pc.binary_length(lines).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(single & (size > 0))
        blank = [i for i in at[size[at] == 1].tolist() if lines[i].as_py() == b"\r"]
        at = at[~np.isin(at, blank)]
        rows = at + first
        if self.need_header and (len(rows) or whole_rows):
            self.need_header = False
            if len(rows) and (not whole_rows or rows[0] < whole_rows[0]):
                at, rows = at[1:], rows[1:]
            else:
                whole_rows, whole = whole_rows[1:], whole[1:]
        if len(rows):
            yield self._plain(rows, lines.take(pa.array(at)))
        if whole:
            yield self._whole(whole_rows, whole)

    def end(self):
        if self.key is None:
            return
        if self.head:  # the whole block lies inside one value
            yield self._fragment(self.owner, -1, self.head)
        if self.open:
            if self.split:
                yield self._fragment(self.block, self.open_row, self.open)
            else:  # a quote that is never closed
                yield self._whole([self.open_row], [b"\n".join(self.open)])

    def run(self, batches):
        for b in batches:
            for file, block, length, size, lines in _segments(b):
                if self.key != (file, block):
                    yield from self.end()
                    self._begin(file, block, length, size)
                yield from self.lines(lines)
        yield from self.end()


def _records(spark: SparkSession, path, layout: Layout) -> DataFrame:
    parsed = _lines(spark, path).mapInArrow(lambda batches: _Cutter(layout).run(batches), PARSED)
    if not layout.inside:
        return parsed.drop("owner", "part")
    whole = parsed.where("owner IS NULL").drop("owner", "part")
    parts = (parsed.where("owner IS NOT NULL").groupBy("file", "owner")
             .agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("parts"),
                  F.max("row").alias("row"), F.first("expected").alias("expected")))

    def join(batches):
        cutter = _Cutter(layout)
        for b in batches:
            for r in b.to_pylist():
                names = layout.headers.get(r["file"], layout.common)
                cutter.file, cutter.block, cutter.expected = r["file"], r["owner"], r["expected"]
                cutter.bound = cutter._bound(names)
                yield cutter._whole([r["row"]], [b"\n".join(p["part"] for p in r["parts"])])

    return whole.unionByName(parts.mapInArrow(join, PARSED).drop("owner", "part"))


def _bad(short_rows: str) -> Column:
    if short_rows not in ("pad", "bad"):
        raise ValueError(f"short_rows: {short_rows}")
    wrong = (F.col("n_fields") > F.col("expected")) | (F.col("n_fields") < 0)
    return wrong | (F.col("n_fields") < F.col("expected")) if short_rows == "bad" else wrong


def read_csv(spark: SparkSession, path, bad_rows: str = "fail", short_rows: str = "pad",
             position: str | None = None, layout: Layout | None = None) -> DataFrame:
    """All columns of the header CSV files under ``path`` as text.

    ``bad_rows``: a record with too many fields, or a quote that is never closed, fails the job
    ("fail") or is left out ("reject"; ``csv_rejects`` has it). ``position`` names a column that
    orders rows as the files do. Without any header the frame has no columns.
    """
    if bad_rows not in ("fail", "reject"):
        raise ValueError(f"bad_rows: {bad_rows}")
    layout = layout or csv_layout(spark, path)
    rows, bad = _records(spark, path, layout), _bad(short_rows)
    if bad_rows == "fail":
        say = F.concat(F.lit("CSV record with "), F.col("n_fields").cast("string"), F.lit(" fields instead of "),
                       F.col("expected").cast("string"), F.lit(" in "), F.col("file"), F.lit(": "), F.substring("raw", 1, 200))
        rows = rows.where(F.when(bad, F.raise_error(say).cast("boolean")).otherwise(F.lit(True)))
    else:
        rows = rows.where(~bad)
    place = [F.struct("file", "block", "row").alias(position)] if position else []
    return rows.select(*[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(layout.names)], *place)


def csv_rejects(spark: SparkSession, path, short_rows: str = "pad", layout: Layout | None = None) -> DataFrame:
    """file, block, row, n_fields (-1: a quote is not closed), expected, record: what ``read_csv`` leaves out."""
    layout = layout or csv_layout(spark, path)
    return (_records(spark, path, layout).where(_bad(short_rows))
            .select("file", "block", "row", "n_fields", "expected", F.col("raw").alias("record")))
