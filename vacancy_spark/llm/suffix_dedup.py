"""Removal of long byte strings that appear more than once, by merging shards' BWTs.

A byte goes when a string of ``length`` bytes that covers it starts at two places or more, in one
document or several. The work is cut by content: a string's smallest 32-byte gram (by hash, the
leftmost of equal ones) depends on the string alone, so strings that are equal belong to the same
gram. Consecutive strings with the same smallest gram form a piece, a little longer than
``length``. Grams that one piece has can be forgotten; pieces that are equal as wholes are
repeated as wholes and stand for one from here on.

The pieces that share a gram with a different piece are dealt into tasks by gram and into shards.
Each shard's pieces get a Burrows-Wheeler transform over all their suffixes. A task merges its
shards' transforms: the interleave, in which the suffixes of all shards are ordered by their
first h bytes, is refined to h + 1 bytes by passing it once and dealing each suffix's extension
to the left, by the byte in the transform, behind those dealt before. Where neighbours come from
different intervals, their common prefix ends at h; an interval of one suffix is settled and its
extensions are passed over. After ``length`` rounds the intervals left are the repeated strings.
Places come from walking each transform from the pieces' ends. No suffix is sorted again.

A gram with very many different pieces is not brought to one task: its strings are counted one by
one by a 128-bit hash of their bytes, combined before the shuffle.

Null texts are empty. Matches never cross documents; repeated rows are documents like any others,
so they remove each other. Ids may be null or repeat. All columns of the input are kept, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacancy_spark.llm._encode import _ranges
from vacancy_spark.llm._shared import documents, narrow_batches, packed_texts, stored, tidy, unpacked
from vacancy_spark.llm._words import _BASE, _BYTE, batches_of, mixed, powers, text_bytes

LENGTH = 200
GRAM = 32
SHARDS = 4
TASK_PIECES = 3_000
CROWD = 20_000  # different pieces of one gram beyond which its strings are counted one by one
BATCH_BYTES = 1 << 18  # of texts that are cut at once
_SECOND = 0xC2B2AE3D27D4EB4F  # base of a second hash, odd


class _Hashes:
    """Hashes of any spans of ``data``; equal bytes have equal hashes."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        self.inverse = powers(pow(base, -1, 1 << 64), len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(base, len(data)), out=self.total[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        own = (self.total[end] - self.total[start]) * self.inverse[start]
        return mixed(own + mixed((end - start).astype(np.uint64)))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of x[i : i + width] for each i."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def pieces(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, piece hash, start in the text, number of strings) of all pieces."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    gram = min(GRAM, length)
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 5
    hashes = _Hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = hashes.spans(at, at + gram)
    low = np.uint64((1 << int(len(data)).bit_length()) - 1)
    smallest = _sliding_min((grams & ~low) | at.astype(np.uint64), length - gram + 1)
    where = (smallest & low).astype(np.int64)
    inside = np.zeros(len(where) + 1, bool)
    ends = np.maximum(bounds[1:] - length + 1, bounds[:-1])
    inside[:-1][_ranges(bounds[:-1], ends - bounds[:-1])] = True
    new = inside[:-1].copy()
    new[1:] &= ~inside[:-2] | (where[1:] != where[:-1])
    first = np.flatnonzero(new)
    stop = new | ~inside[:-1]
    stop = np.append(np.flatnonzero(stop[1:]) + 1, len(where)) if len(where) else first
    last = stop[np.searchsorted(stop, first, side="right")]
    text = np.searchsorted(bounds, first, side="right") - 1
    return (text, grams[where[first]], hashes.spans(first, last - 1 + length),
            first - bounds[text], last - first)


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """BWT of all suffixes of the strings, and its rows that stand for a string's beginning.

    String i ends with a sign of its own that sorts as i, before every byte; the first rows are
    those signs. Suffixes are ranked by their first seven symbols, then by doubling; only those
    that share their rank with others are looked at again.
    """
    m = len(strings)
    lengths = np.array([len(s) + 1 for s in strings], np.int64)
    data = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    n = len(data)
    end = np.cumsum(lengths) - 1
    symbol = data.astype(np.int64) + 1
    symbol[end] = 0
    key, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for j in range(7):  # nine bits a symbol, none after the end sign
        here = np.zeros(n, np.int64)
        here[:max(0, n - j)] = symbol[j:]
        here[ended] = 0
        key = (key << 9) | here
        ended |= here == 0
    # equal suffixes that have ended differ by their signs, which sort as the strings do
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | ended[order][1:]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # first place of the equals
    k = 7
    alone = new & np.append(new[1:], True)
    left = order[~alone]  # those still equal to others, in order
    while len(left):
        second = rank[left + k]
        own = rank[left]
        by = np.lexsort((second, own))
        left, own, second = left[by], own[by], second[by]
        edge = np.ones(len(left), bool)
        edge[1:] = own[1:] != own[:-1]
        place = own + np.arange(len(left)) - np.maximum.accumulate(np.where(edge, np.arange(len(left)), 0))
        new = edge.copy()
        new[1:] |= second[1:] != second[:-1]
        rank[left] = np.maximum.accumulate(np.where(new, place, 0))
        left = left[~(new & np.append(new[1:], True))]
        k *= 2
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    begins = np.zeros(n, bool)
    begins[end - lengths + 1] = True
    return data[place - 1], np.flatnonzero(begins[place])


def _steps(bwt: np.ndarray, begins: np.ndarray, m: int) -> np.ndarray:
    """For each row, the row of the suffix one byte longer to the left (-1: at a beginning)."""
    step = np.full(len(bwt), -1, np.int64)
    rows = np.ones(len(bwt), bool)
    rows[begins] = False
    rows = np.flatnonzero(rows)
    step[rows[np.argsort(bwt[rows], kind="stable")]] = m + np.arange(len(rows))
    return step


def merged_repeats(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int
                   ) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every string of ``length`` bytes that appears twice or more.

    ``shards``: (BWT, rows of beginnings, lengths of the strings). Strings are numbered through.
    """
    bwt = np.concatenate([s[0] for s in shards])
    first = np.cumsum([0, *(len(s[0]) for s in shards)])
    step = np.concatenate([np.where(x >= 0, x + a, -1) for a, x in zip(
        first, (_steps(b, begins, len(k)) for b, begins, k in shards))]).astype(np.int32)
    lengths = np.concatenate([s[2] for s in shards]).astype(np.int32)
    string, offset = np.zeros(len(bwt), np.int32), np.zeros(len(bwt), np.int32)
    who = np.arange(len(lengths), dtype=np.int32)
    at = np.concatenate([a + np.arange(len(s[2])) for a, s in zip(first, shards)])
    left = lengths.copy()
    while len(at):  # walk from the ends to the beginnings
        string[at], offset[at] = who, left
        at = step[at]
        on = at >= 0
        at, who, left = at[on], who[on], left[on] - 1

    # ordered by 0 bytes: shard after shard. What ends before ``length`` never gets that long
    rows = np.flatnonzero(offset >= length).astype(np.int32)
    interval = np.zeros(len(rows), np.int32)
    for _ in range(length):
        if not len(rows):
            break
        byte = bwt[rows]
        order = np.argsort(byte, kind="stable")
        byte, interval, rows = byte[order], interval[order], step[rows[order]]
        edge = np.ones(len(rows) + 1, bool)
        edge[1:-1] = (byte[1:] != byte[:-1]) | (interval[1:] != interval[:-1])
        open_ = ~(edge[1:] & edge[:-1])
        rows, interval = rows[open_], np.cumsum(edge[:-1], dtype=np.int32)[open_]
    return string[rows].astype(np.int64), offset[rows].astype(np.int64)


def _spans(doc: np.ndarray, start: np.ndarray, string: np.ndarray, offset: np.ndarray,
           length: int) -> pa.Table:
    """Places as (doc_no, from, to) spans of bytes, runs of offsets joined."""
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (offset[1:] > offset[:-1] + length)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(string)) - 1 if len(a) else a
    return pa.table({"doc_no": doc[string[a]], "from": start[string[a]] + offset[a],
                     "to": start[string[a]] + offset[z] + length},
                    schema=pa.schema([(x, pa.int64()) for x in ("doc_no", "from", "to")]))


SPANS = "doc_no long, from long, to long"


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """Rows (doc_no, gram, piece, start, strings) of all pieces, and for each document one row
    (doc_no, doc_id, text_hash) without a gram."""
    names = ["doc_no", "gram", "piece", "start", "strings", "doc_id", "text_hash"]

    def run(batches):
        done = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = text_bytes(b.column("text"))
            for part in batches_of([len(t) for t in texts], BATCH_BYTES):
                own = texts[part]
                doc, gram, piece, start, strings = pieces(own, length)
                none = pa.nulls(len(doc), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(done + doc), pa.array(gram.view(np.int64)),
                     pa.array(piece.view(np.int64)), pa.array(start), pa.array(strings), none, none],
                    names)
                none = pa.nulls(len(own), pa.int64())
                size = part.stop - part.start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(done + np.arange(size)), none, none, none, none,
                     b.column("doc_id").slice(part.start, size),
                     b.column("text_hash").slice(part.start, size)], names)
                done += size

    return docs.select("doc_id", "text_hash", "text").mapInArrow(tidy(run), ", ".join(f"{x} long" for x in names))


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD,
                   task_pieces: int = TASK_PIECES) -> DataFrame:
    """doc_id, text_hash, from, to: spans of bytes to remove (they may overlap).

    ``docs``: doc_id, text_hash, text (not null).
    """
    cut = stored(_cut(docs, length), "pieces")
    keys = cut.where("gram is null").select("doc_no", "doc_id", "text_hash")
    rows = cut.where("gram is not null").select("gram", "piece", "doc_no", "start", "strings")
    # written, so that the join has a shuffle of its own for each side and can split a hot gram
    grams = stored(rows.groupBy("gram").count().where("count > 1").select("gram"), "shared-grams")
    rows = stored(rows.join(grams, "gram"), "shared-pieces")
    kinds = stored(rows.groupBy("gram", "piece").agg(
        F.count("*").alias("times"), F.min(F.struct("doc_no", "start", "strings")).alias("one"))
        .select("gram", "piece", "times", "one.*"), "piece-kinds")
    whole = (rows.join(kinds.where("times > 1").select("gram", "piece"), ["gram", "piece"])
             .select("doc_no", F.col("start").alias("from"),
                     (F.col("start") + F.col("strings") + length - 1).alias("to")))

    many = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = stored(kinds.join(many, "gram"), "mixed-pieces")
    n = wanted.where(F.col("kinds") <= crowd).count()
    lists = (wanted.groupBy("doc_no").agg(F.collect_list(F.struct(
        "gram", "piece", "times", "start", "strings", "kinds")).alias("pieces"))
        .join(keys, "doc_no").withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "hash"))
    fields = ["gram", "piece", "times", "start", "strings", "kinds"]

    def fetch(batches):
        for b in batches:
            texts = unpacked(b.column("packed"))
            found = b.column("pieces")
            counts = np.diff(found.offsets.to_numpy())
            flat = found.flatten()
            doc = np.repeat(np.arange(len(texts)), counts)
            start = flat.field("start").to_numpy()
            size = flat.field("strings").to_numpy() + length - 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_no").take(pa.array(doc)), *(flat.field(c) for c in fields),
                 pa.array([texts[d][a:a + k] for d, a, k in zip(doc, start, size)], pa.binary())],
                ["doc_no", *fields, "bytes"])

    packed = packed_texts(docs.select("doc_id", "text_hash", "text"))
    strings = (packed.join(lists, packed["doc_id"].eqNullSafe(lists["id"])
                           & (packed["text_hash"] == lists["hash"]))
               .select("doc_no", "pieces", "packed")
               .mapInArrow(tidy(fetch), "doc_no long, gram long, piece long, times long, start long, "
                                  "strings long, kinds long, bytes binary"))
    strings = stored(strings, "piece-bytes")

    def build(table: pa.Table) -> pa.Table:
        # rows that repeat an id and its text were fetched alike; one of them is enough
        key = np.stack([table.column(c).to_numpy() for c in ("gram", "piece")])
        table = table.take(pa.array(np.unique(key, axis=1, return_index=True)[1]))
        own = table.column("bytes").to_pylist()
        bwt, begins = transform(own)
        lists = {c: table.column(c).to_numpy() for c in ("doc_no", "start", "times")}
        return pa.table({
            "task": table.column("task").slice(0, 1), "bwt": pa.array([bwt.tobytes()], pa.binary()),
            "begins": pa.array([begins], pa.list_(pa.int64())),
            "lengths": pa.array([[len(s) for s in own]], pa.list_(pa.int64())),
            **{c: pa.array([x], pa.list_(pa.int64())) for c, x in lists.items()}})

    def merge(table: pa.Table) -> pa.Table:
        listed = lambda c: [x.values.to_numpy() for x in table.column(c)]
        shards = list(zip([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bwt")],
                          listed("begins"), listed("lengths")))
        string, offset = merged_repeats(shards, length)
        doc, start, times = (np.concatenate(listed(c)) for c in ("doc_no", "start", "times"))
        once = times[string] == 1  # the others are removed whole
        return _spans(doc, start, string[once], offset[once], length)

    few = (strings.where(F.col("kinds") <= crowd)
           .withColumn("task", F.pmod(F.xxhash64("gram"), F.lit(-(-n // task_pieces) or 1)))
           .withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(SHARDS)))
           .select("task", "shard", "gram", "piece", "doc_no", "start", "times", "bytes"))
    part = (few.groupBy("task", "shard").applyInArrow(
        build, "task long, bwt binary, begins array<long>, lengths array<long>, "
               "doc_no array<long>, start array<long>, times array<long>")
        .groupBy("task").applyInArrow(merge, SPANS))

    def windows(batches):
        for b in batches:
            raw = b.column("bytes").to_pylist()
            size = np.array([len(x) for x in raw])
            data = np.frombuffer(b"".join(raw), np.uint8)
            count = size - length + 1
            inside = _ranges(np.zeros(len(size), np.int64), count)
            at = np.repeat(np.cumsum(size) - size, count) + inside
            one, two = (_Hashes(data, base).spans(at, at + length) for base in (_BASE, _SECOND))
            own = lambda c: np.repeat(b.column(c).to_numpy(), count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(own("doc_no")),
                 pa.array(own("start") + inside), pa.array(own("times"))],
                ["one", "two", "doc_no", "from", "times"])

    crowded = (strings.where(F.col("kinds") > crowd).dropDuplicates(["gram", "piece"])
               .select("doc_no", "start", "times", "bytes")
               .mapInArrow(tidy(windows), "one long, two long, doc_no long, from long, times long"))
    twice = crowded.groupBy("one", "two").agg(F.sum("times").alias("all")).where("all > 1")
    one_by_one = (crowded.where("times = 1").join(twice.select("one", "two"), ["one", "two"])
                  .select("doc_no", "from", (F.col("from") + length).alias("to")))
    spans = whole.unionByName(part)
    if not strings.where(F.col("kinds") > crowd).isEmpty():
        spans = spans.unionByName(one_by_one)
    return spans.join(keys, "doc_no").select("doc_id", "text_hash", "from", "to").distinct()


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id",
                   text_col: str = "text", with_text: bool = False, **options) -> DataFrame:
    """All columns of ``docs`` but the text, and kept (bytes), n_bytes, n_removed, n_spans.

    ``with_text``: also kept_text, the whole characters that are left. Columns of ``docs`` that have
    these names are replaced.
    """
    narrow_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    whole = docs.select(F.struct(*rest).alias("rest"), F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(text_col, F.lit("")).alias("text"))
    whole = whole.withColumn("text_hash", F.xxhash64("text"))
    spans = stored(repeated_spans(whole.select("doc_id", "text_hash", "text"), length, **options)
                   .groupBy("doc_id", "text_hash")
                   .agg(F.collect_list(F.struct("from", "to")).alias("spans")), "spans")

    schema = T.StructType([T.StructField("rest", whole.schema["rest"].dataType),
                           T.StructField("kept", T.BinaryType()),
                           *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
                           *([T.StructField("kept_text", T.StringType())] * with_text)])

    def remove(batches):
        for b in batches:
            kept, sizes = [], []
            for text, found in zip(unpacked(b.column("packed")), b.column("spans").to_pylist()):
                parts, at, runs, removed = [], 0, 0, 0
                for a, z in sorted((s["from"], s["to"]) for s in found or ()):
                    if a > at or not runs:  # spans that touch are one run
                        parts.append(text[at:a])
                        runs += 1
                    removed += max(0, z - max(a, at))
                    at = max(at, z)
                parts.append(text[at:])
                kept.append(b"".join(parts))
                sizes.append((len(text), removed, runs))
            yield pa.RecordBatch.from_arrays(
                [b.column("rest"), pa.array(kept, pa.binary()),
                 *(pa.array([s[i] for s in sizes], pa.int64()) for i in range(3)),
                 *([pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())] * with_text)],
                schema.names)

    packed = packed_texts(whole)
    spans = spans.withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    out = (packed.join(spans, packed["doc_id"].eqNullSafe(spans["id"])
                       & (packed["text_hash"] == spans["hash"]), "left")
           .select("rest", "packed", "spans").mapInArrow(tidy(remove), schema))
    return out.select(*[F.col("rest").getField(c).alias(c) for c in rest if c not in schema.names[1:]],
                      *schema.names[1:])


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that appear again."""
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
