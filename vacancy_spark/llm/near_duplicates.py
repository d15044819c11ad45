"""Near-duplicates by n-gram Jaccard similarity: a chosen-path join.

A document is the set of its five-word shingles (words lower-cased over A-Z; fewer than five
words are one shingle). Equal sets are brought together first and stand for one set with copies.

Each set has 128 minhash values; the token (i, value i) is shared by two sets with probability
equal to their similarity. A run starts at a root that holds all sets. A node splits its sets by
one or two tokens sampled for that node (1 / 0.8 on average), a child for each value. Nodes of
at most ``leaf`` sets are compared by brute force on the minhash values. In a larger node one
member, the hub, is compared with all and joined with those that may be near it; pairs among
these need no further search, so the node is split on only if it holds others, and without the
members very close to the hub. Runs repeat until a pair at the threshold is found with the target recall,
reckoned for the deepest level that any node reached.

What comparing yields is only which sets may belong together (a forest, not all pairs), with a
margin below the threshold. Within these candidate groups every pair is then compared exactly, in
blocks of bounded size, so links missed by sampling inside a group are found too. A block returns
one row per set: its number of linked documents and a set it is connected with.

Null and empty texts, and texts without a word, have no shingle: each is a class of its own
(numbered by its id) without links. Repeated rows are copies like any others; ids may be null (the class is then
numbered from -1 down unless it has a document with an id). Extra columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancy_spark.llm._components import components
from vacancy_spark.llm._shared import (documents, narrow_batches, packed_texts, stored, stored_alone, tidy,
                                       unpacked)
from vacancy_spark.llm._words import Words, batches_of, mixed, text_bytes

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 128
LEAF = 4000
RECALL = 0.9999
MARGIN = 0.14  # four standard deviations of a similarity of 0.8 estimated from 128 values
CLOSE = 0.93  # estimated similarity to the hub at which a member leaves a large node
BLOCK = 1024
BATCH_BYTES = 1 << 18
CELLS = 1 << 20  # of the table that a block's sets are compared in, some shingles at a time

_FACTORS = np.random.default_rng(5).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and each text's number."""
    w = Words(texts, lower=True)
    window, whole = w.windows(size)
    if size > 1:  # a text of fewer words is one shingle
        short = np.flatnonzero((w.counts > 0) & (w.counts < size))
        for d in short:
            a, z = w.first[d], w.first[d + 1]
            x = np.uint64(z - a)
            for h in w.hash[a:z]:
                x = mixed(np.array([x ^ h], np.uint64))[0]
            window[a], whole[a] = x, True
    doc, key = w.doc[whole], window[whole]
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], np.bincount(doc[new], minlength=len(texts)).astype(np.int64)


def _minhashes(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, HASHES) uint32: the smallest product of a shingle's hash by each factor."""
    out = np.empty((len(starts), HASHES), np.uint32)
    if len(starts):
        for i, f in enumerate(_FACTORS):
            out[:, i] = (np.minimum.reduceat(flat * f, starts) >> np.uint64(32)).astype(np.uint32)
    return out


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, set_id (null: no shingle), values (minhashes), sketch (their lowest
    bytes)."""
    names = ["doc_id", "text_hash", "set_id", "values", "sketch"]

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column("text"))
            sets, values, sketch = [], [], []
            for part in batches_of([len(t) for t in texts], BATCH_BYTES):
                flat, counts = shingle_sets(texts[part])
                some = counts > 0
                starts = (np.cumsum(counts) - counts)[some]
                found = _minhashes(flat, starts)
                low = iter((found & 0xFF).astype(np.uint8))
                found = iter(found)
                m = mixed(flat)
                one = iter(np.add.reduceat(m, starts) if len(starts) else ())
                two = iter(np.add.reduceat(mixed(m ^ np.uint64(0x5DEECE66D)), starts)
                           if len(starts) else ())
                for full in some:
                    sets.append(next(one).tobytes() + next(two).tobytes() if full else None)
                    values.append(next(found).tobytes() if full else None)
                    sketch.append(next(low).tobytes() if full else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(sets, pa.binary()),
                 pa.array(values, pa.binary()), pa.array(sketch, pa.binary())], names)

    narrow_batches(docs.sparkSession)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
            .mapInArrow(tidy(run), "doc_id long, text_hash long, set_id binary, values binary, "
                             "sketch binary"))


def _column(column: pa.Array, kind=np.uint32) -> np.ndarray:
    """The minhash values (or, as uint8, their lowest bytes) in a binary column, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, HASHES)


def _children(node: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node): one token sampled for the node, a second one with probability 1/4."""
    r = mixed(node ^ np.uint64(0xA5A5A5A5))
    first = (r % np.uint64(HASHES)).astype(np.int64)
    second = ((first + 1 + (r >> np.uint64(20)) % np.uint64(HASHES - 1)) % HASHES).astype(np.int64)
    more = np.flatnonzero(r >> np.uint64(62) == 0)
    row = np.concatenate([np.arange(len(node)), more])
    token = np.concatenate([first, second[more]])
    child = mixed(mixed(node[row] + token.astype(np.uint64)) ^ values[row, token])
    return row, child


def _rows_of(node: np.ndarray, who: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(who, pa.int64())],
                                      ["node", "set_no"])


def _recall(depth: int) -> float:
    """Probability that one run brings a pair at the threshold together at this depth."""
    p = 1.0
    for _ in range(depth):
        miss = 1 - THRESHOLD * p
        p = 1 - (0.75 * miss + 0.25 * miss * miss)
    return p


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest member each of n items is connected with by the pairs (x, y)."""
    root = np.arange(n)
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    while not np.array_equal(root, root[root]):
        root = root[root]
    return root


def _run_paths(sets: DataFrame, runs: range, leaf: int, floor: float) -> tuple[list[DataFrame], int]:
    """Candidate edges (a, b) found by these runs, and the deepest level reached."""
    low = float(floor)

    def roots(batches):
        for b in batches:
            values, who = _column(b.column("values")), b.column("set_no").to_numpy()
            for r in runs:
                node = np.full(len(who), mixed(np.array([r + 1], np.uint64))[0], np.uint64)
                row, child = _children(node, values)
                yield _rows_of(child, who[row])

    def compare(batches):
        for b in batches:
            near = (_column(b.column("sketch"), np.uint8)
                    == _column(b.column("hub_sketch"), np.uint8)).mean(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("set_no"), b.column("hub_no"), pa.array(near)],
                ["node", "set_no", "hub_no", "near"])

    def split(batches):
        for b in batches:
            row, child = _children(b.column("node").to_numpy().view(np.uint64),
                                   _column(b.column("values")))
            yield _rows_of(child, b.column("set_no").to_numpy()[row])

    def brute(batches):
        for b in batches:
            members = b.column("members")
            flat = members.flatten()
            ends = np.cumsum(np.diff(members.offsets.to_numpy()))
            who = flat.field("set_no").to_numpy()
            sketch = _column(flat.field("sketch"), np.uint8)
            a, c = [], []
            for s, e in zip(np.r_[0, ends[:-1]], ends):
                v, n = sketch[s:e], e - s
                xs, ys = [], []
                for i in range(n - 1):
                    y = np.flatnonzero((v[i + 1:] == v[i]).mean(axis=1) >= low)
                    xs.append(np.full(len(y), i))
                    ys.append(y + i + 1)
                root = _forest(n, np.concatenate(xs), np.concatenate(ys))
                off = np.flatnonzero(root != np.arange(n))
                a.append(who[s:e][root[off]])
                c.append(who[s:e][off])
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([join(a), join(c)], ["a", "b"])

    schema = "node long, set_no long"
    paths = stored(sets.select("set_no", "values").mapInArrow(tidy(roots), schema), "paths")
    edges, depth = [], 1
    while True:
        sizes = stored(paths.groupBy("node").count().where("count > 1"), "path-sizes")
        small = (paths.join(sizes.where(F.col("count") <= leaf).select("node"), "node")
                 .groupBy("node").agg(F.sort_array(F.collect_list("set_no")).alias("group"))
                 # the same sets meet in many nodes; each group is compared once
                 .groupBy("group").agg(F.min("node").alias("node"))
                 .select("node", F.explode("group").alias("set_no"))
                 .join(sets.select("set_no", "sketch"), "set_no")
                 .groupBy("node").agg(F.collect_list(F.struct("set_no", "sketch")).alias("members")))
        edges.append(small.select("members").mapInArrow(tidy(brute), "a long, b long"))
        big = sizes.where(F.col("count") > leaf)
        if big.isEmpty():
            return edges, depth
        inside = paths.join(big.select("node"), "node")
        hubs = (inside.groupBy("node").agg(F.min(F.struct(
            F.xxhash64("node", "set_no"), "set_no"))["set_no"].alias("hub_no"))
            .join(sets.select(F.col("set_no").alias("hub_no"), F.col("sketch").alias("hub_sketch")),
                  "hub_no"))
        met = stored(inside.join(sets.select("set_no", "sketch"), "set_no").join(hubs, "node")
                     .select("node", "set_no", "sketch", "hub_no", "hub_sketch")
                     .mapInArrow(tidy(compare), "node long, set_no long, hub_no long, near double"), "hubs")
        # a set at 0.9 of the hub or more has only partners at 0.7 or more: they join the hub's
        # group, and so do all sets that may be such partners
        with_hub = F.col("near") >= 1 - 2 * (1 - THRESHOLD) + 0.1 - MARGIN
        edges.append(met.where(with_hub & (F.col("set_no") != F.col("hub_no")))
                     .select(F.col("hub_no").alias("a"), F.col("set_no").alias("b")))
        # pairs within the hub's group are found: a node goes on only if some set is outside it,
        # with those of its sets that may have a partner there
        outside = met.where(~with_hub).select("node").distinct()
        paths = stored(met.where(F.col("near") < CLOSE).select("node", "set_no").join(outside, "node")
                       .join(sets.select("set_no", "values"), "set_no")
                       .select("node", "set_no", "values")
                       .mapInArrow(tidy(split), schema), "paths")
        depth += 1


def compare_block(flat: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray,
                  threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (one of ``left``, one of ``right``) of sets at the threshold or above.

    Only shingles that two of the sets share are counted, some at a time.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    kinds, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = max(1, CELLS // max(1, len(counts)))
    for a in range(0, int(shared.sum()), width):
        s, e = np.searchsorted(column, [a, a + width])
        m = np.zeros((len(counts), min(width, int(shared.sum()) - a)), np.float32)
        m[owner[s:e], column[s:e] - a] = 1
        both += m[left] @ m[right].T
    union = counts[left][:, None] + counts[right][None, :] - both
    x, y = np.nonzero(both >= threshold * union - 1e-6)
    return left[x], right[y]


def _links(rows: DataFrame, threshold: float) -> DataFrame:
    """Exact comparison within candidate groups.

    ``rows``: (task, part, unit, side, set_no, copies, shingles); sets of one unit are compared
    with each other, or side 0 with side 1. Returns (set_no, root, links) once per set and unit.
    """
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("unit", "ascending"), ("set_no", "ascending")])
        lists = table.column("shingles").combine_chunks()
        flat = lists.flatten().to_numpy().view(np.uint64)
        counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        at = np.cumsum(counts) - counts
        unit, side = table.column("unit").to_numpy(), table.column("side").to_numpy()
        who, copies = table.column("set_no").to_numpy(), table.column("copies").to_numpy()
        root, links = who.copy(), np.zeros(len(who), np.int64)
        edges = np.r_[0, np.flatnonzero(np.diff(unit)) + 1, len(unit)]
        for s, e in zip(edges[:-1], edges[1:]):
            n = e - s
            own = side[s:e]
            left, right = (np.arange(n),) * 2 if (own == 0).all() else (
                np.flatnonzero(own == 0), np.flatnonzero(own == 1))
            x, y = compare_block(flat[at[s]:at[e - 1] + counts[e - 1]], counts[s:e], left, right,
                                 threshold)
            other = x != y
            x, y = x[other], y[other]
            np.add.at(links, s + x, copies[s + y])
            if left is not right:
                np.add.at(links, s + y, copies[s + x])
            root[s:e] = who[s:e][_forest(n, x, y)]
        return pa.table({"set_no": who, "root": root, "links": links})

    return rows.groupBy("task").applyInArrow(run, "set_no long, root long, links long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                    leaf: int = LEAF, block: int = BLOCK, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, class_id, n_links, is_first for every document.

    ``class_id``: smallest id of the documents connected by links; ``n_links``: number of other
    documents at the threshold or above, copies included; ``is_first``: one row of each class.
    ``threshold`` must be at least THRESHOLD, for which the paths are sampled.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"paths are sampled for similarities of {THRESHOLD} or more")
    rows = stored(_sketches(docs, id_col, text_col)
                  .withColumn("row_no", F.monotonically_increasing_id()), "sketches")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row_no", "text_hash")
    sets = stored(rows.where("set_id is not null").groupBy("set_id")
                  .agg(F.count("*").alias("copies"), F.first("values").alias("values"),
                       F.first("sketch").alias("sketch"),
                       F.min(first).alias("first"))
                  .withColumn("set_no", F.monotonically_increasing_id()), "sets")

    edges, done, needed = [], 0, 1
    depth = 1
    while done < needed:
        needed = math.ceil(math.log(1 - recall) / math.log(1 - _recall(depth)))
        if needed > done:
            found, reached = _run_paths(sets, range(done, needed), leaf, threshold - MARGIN)
            edges += found
            done, depth = needed, max(depth, reached)
            needed = math.ceil(math.log(1 - recall) / math.log(1 - _recall(depth)))
    union = edges[0]
    for e in edges[1:]:
        union = union.unionByName(e)
    group = stored(components(union), "candidate-groups")

    # every candidate group whole, or dealt into blocks that are compared pair by pair
    sizes = group.groupBy("component").agg(F.count("*").alias("n"))
    member = (group.withColumnRenamed("node", "set_no").join(sizes, "component")
              .join(sets.select("set_no", "copies", "first.doc_id", "first.text_hash"), "set_no"))
    member = stored(member, "candidates")
    n_small = member.where(F.col("n") <= block).count()

    def shingles(batches):
        for b in batches:
            texts = unpacked(b.column("packed"))
            for part in batches_of([len(t) for t in texts], BATCH_BYTES):
                flat, counts = shingle_sets(texts[part])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                own = [b.column(c).slice(part.start, part.stop - part.start)
                       for c in ("component", "n", "set_no", "copies")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.ListArray.from_arrays(pa.array(offsets),
                                                    pa.array(flat.view(np.int64)))],
                    ["component", "n", "set_no", "copies", "shingles"])

    texts = packed_texts(docs.select(F.col(id_col).cast("long").alias("id"),
                                     F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")))
    # the candidates' size is not bounded: a shuffle join at every size
    sets_of = (texts.join(member.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id"))
                          & (F.col("hash") == F.col("text_hash")))
               .select("component", "n", "set_no", "copies", "packed")
               .mapInArrow(tidy(shingles), "component long, n long, set_no long, copies long, "
                                     "shingles array<long>"))
    # rows that repeat an id and its text are one set; one of them is compared
    sets_of = stored(sets_of.groupBy("set_no").agg(
        *[F.first(c).alias(c) for c in ("component", "n", "copies", "shingles")]), "candidate-sets")
    small = (sets_of.where(F.col("n") <= block)
             .withColumn("task", F.pmod(F.xxhash64("component"), F.lit(-(-n_small // block) or 1)))
             .select("task", F.col("component").alias("unit"), F.lit(0).alias("side"), "set_no",
                     "copies", "shingles"))
    parts = F.ceil(F.col("n") / block)
    large = (sets_of.where(F.col("n") > block).withColumn("parts", parts)
             .withColumn("part", F.pmod(F.xxhash64("set_no", "component"), F.col("parts")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
             .select(F.xxhash64("component", F.least("part", "other"),
                                F.greatest("part", "other")).alias("task"),
                     F.lit(0).cast("long").alias("unit"),
                     (F.col("part") > F.col("other")).cast("int").alias("side"), "set_no",
                     "copies", "shingles"))
    linked = _links(small, threshold).unionByName(_links(large, threshold))
    linked = stored(linked.groupBy("set_no", "root").agg(F.sum("links").alias("links")), "links")
    joined = components(linked.where("links > 0").select(F.col("set_no").alias("a"),
                                                         F.col("root").alias("b")))
    links = linked.groupBy("set_no").agg(F.sum("links").alias("links"))
    sets = stored(sets.select("set_id", "set_no", "copies", "first")
                  .join(joined.withColumnRenamed("node", "set_no"), "set_no", "left")
                  .join(links, "set_no", "left")
                  .select("set_id", "copies", "first", F.coalesce("component", "set_no").alias("class"),
                          F.coalesce("links", F.lit(0)).alias("links")), "linked-sets")
    heads = sets.groupBy("class").agg(F.min("first").alias("head"))
    sets = sets.join(heads, "class").select(
        "set_id", "head", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = rows.drop("values", "sketch").join(sets, "set_id", "left")
    own = F.coalesce("head.doc_id", F.when(F.col("set_id").isNull(), F.col("doc_id")))
    number = F.coalesce("head.row_no", "row_no")
    return out.select("doc_id", "text_hash", F.coalesce(own, -1 - number).alias("class_id"),
                      F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      (F.col("row_no") == number).alias("is_first"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                **options) -> DataFrame:
    """``docs`` with one document of each class left: the one of smallest id."""
    found = stored_alone(lambda: near_duplicates(docs, id_col=id_col, text_col=text_col, **options), "classes")
    first = found.where("is_first").select("doc_id", "text_hash")
    kept = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    kept = kept.join(first, F.col("id").eqNullSafe(F.col("doc_id"))
                     & (F.col("hash") == F.col("text_hash")), "left_semi")
    again = found.groupBy("doc_id", "text_hash").count().where("count > 1")
    if not again.isEmpty():  # rows that repeat both id and text: one of them stays
        wordless = ~F.coalesce(F.regexp_like("text", F.lit("[^\\x20\\x09-\\x0D]")), F.lit(False))
        alone = kept.where(wordless)  # documents without a word are no one's copies
        kept = kept.where(~wordless).dropDuplicates(["id", "hash"]).unionByName(alone)
    return kept.select("row.*")


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")
