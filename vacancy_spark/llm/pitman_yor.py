"""Scores of a hierarchical Pitman-Yor language model, seated by Gibbs sampling.

Words (lower-cased over A-Z) and an end sign for each text are the dishes. Every word that stands
before another one is a restaurant of its own, known by the word's 64-bit hash. They share one
parent, the restaurant of all words, whose own parent is uniform over the known words and one
unknown. A customer takes a table of its dish or opens one, which sends a customer to the parent.
A sweep takes all customers of a dish out of a restaurant and seats them again one after the
other, given everything else; from 64 customers on, several are seated between two updates. After
some sweeps the predictive probabilities are averaged over the seatings of the next ones.

Counting: texts are cut into chunks of bounded size. A chunk sends each bucket its distinct (word,
context) pairs with their counts. A word's pairs lie in one bucket; those of a word that is more
than a bucket's share of all tokens are dealt over several by context, and its customers in the
parent are added up between epochs. The restaurants' totals are kept by context: between epochs
each bucket sends its own tables, one number for each of its contexts, to the parts of the
context table, which add them up and answer with the totals. A bucket answers a chunk with one
probability per pair, and the chunk adds up its documents' logarithms.

Null texts are empty: their one token is the end sign. Ids may be null (such a row is learned
from) or repeat. Extra columns are ignored, whatever their names; an empty table gives no rows.
If nothing is learned from, every token has the uniform probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancy_spark.llm._shared import documents, narrow_batches, stored, tidy
from vacancy_spark.llm._words import Words, batches_of, mixed, text_bytes
from vacancy_spark.session import fresh_path

CONTEXTS = 0  # no fixed number of restaurants: arrays are as long as the contexts that there are
CHUNK_TOKENS = 2_000_000
BUCKET_BYTES = 16 << 20  # of text, for each bucket of words
BATCH_BYTES = 2 << 20
SAMPLE_BYTES = 64 << 20  # of text, to find the words whose pairs are dealt over several buckets
EPOCHS = 3  # before the last one, to bring the restaurants' totals up to date
BURN_IN = 4
SAMPLES = 4
STRENGTH = (10.0, 10.0)  # of the context restaurants and of their parent
SEED = 17

END = np.uint64(0xE4D0F7E47)  # the end sign, and what stands before a text's first word
_ODD = np.uint64(0x9E3779B97F4A7C15)

A_SCHEMA = ("chunk long, words binary, doc_ids array<long>, held array<boolean>, lengths binary, "
            "tokens binary")
P_SCHEMA = "chunk long, bucket long, words binary, pairs binary, contexts binary, counts binary"
# by part: the bucket itself (OWN), its places of a chunk's pairs (WHERE), else a message to a part of the
# context table
C_SCHEMA = ("bucket long, part long, chunk long, places binary, pairs binary, contexts binary, "
            "counts binary, n_contexts long, words long, opened long, taken long, ones long, twos long, "
            "hot_at array<long>, hot_words array<long>, hot_sent array<double>, hot_count array<long>, "
            "hashes binary, tables binary, customers binary")
T_SCHEMA = ("bucket long, part long, index binary, tables binary, opened double, above double, "
            "hot_words array<long>, hot_sent array<double>")
M_SCHEMA = "bucket long, part long, index binary, tables binary, customers binary"
R_SCHEMA = "chunk long, bucket long, known binary, p binary"
S_SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
            "score double")
OWN, WHERE = -1, -2


def _raw(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, dtype=kind).tobytes()


def _planes(x: np.ndarray, size: int = 4) -> bytes:
    """Unsigned numbers of ``size`` bytes, byte by byte, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(
        np.ascontiguousarray(x, f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes())


def _unplanes(raw: bytes, size: int = 4) -> np.ndarray:
    import zstandard

    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(x.reshape(size, -1).T).view(f"<u{size}").reshape(-1).astype(np.int64)


def _joined(raws, size: int = 4) -> tuple[np.ndarray, list[int]]:
    """Numbers of several rows one after the other, and where rows after the first begin."""
    found = [_unplanes(x, size) for x in raws]
    return np.concatenate(found), np.cumsum([len(x) for x in found])[:-1].tolist()


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' hashes (each text's words, then the end sign) and the texts' numbers of them."""
    w = Words(texts, lower=True)
    return np.insert(w.hash, w.first[1:], END), w.counts + 1


def _chunk(chunk: int, docs: list) -> dict:
    """The row of a chunk. ``docs``: (id, held out, tokens) of each document."""
    words, at = np.unique(np.concatenate([d[2] for d in docs]), return_inverse=True)
    return {"chunk": chunk, "words": _raw(words, "<u8"), "doc_ids": [d[0] for d in docs],
            "held": [d[1] for d in docs], "lengths": _raw([len(d[2]) for d in docs], "<i8"),
            "tokens": _planes(at)}


class _Layout:
    """Which bucket a pair lies in: its word's; a hot word's pairs are dealt by context."""

    def __init__(self, buckets: int, hot: dict[int, int]):
        self.buckets = np.uint64(buckets)
        self.hot = np.array(sorted(hot), np.uint64)
        self.ways = np.array([hot[w] for w in sorted(hot)], np.uint64)

    def is_hot(self, word: np.ndarray) -> np.ndarray:
        return np.isin(word, self.hot)

    def bucket(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        found = (word % self.buckets).astype(np.int64)
        some = np.flatnonzero(self.is_hot(word))
        if len(some):
            ways = self.ways[np.searchsorted(self.hot, word[some])]
            way = mixed(context[some]) % ways
            found[some] = mixed(word[some] + way * _ODD) % self.buckets
        return found


def _pairs(words: np.ndarray, at: np.ndarray, lengths: np.ndarray, layout: _Layout):
    """(word, context, bucket) of a chunk's distinct pairs, bucket by bucket, and each token's pair."""
    before = np.empty(len(at), np.int64)
    before[1:] = at[:-1]
    before[np.cumsum(lengths) - lengths] = np.searchsorted(words, END)  # every text has one
    pair, which = np.unique(at * len(words) + before, return_inverse=True)
    word, context = words[pair // len(words)], words[pair % len(words)]
    bucket = layout.bucket(word, context)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return word[order], context[order], bucket[order], place[which]


def _sendings(chunk: int, words, at, lengths, held, layout: _Layout):
    """A chunk's rows for the buckets."""
    word, context, bucket, which = _pairs(words, at, lengths, layout)
    count = np.bincount(which, np.repeat(~held, lengths), len(word)).astype(np.int64)
    kinds, starts = np.unique(bucket, return_index=True)
    for b, s, e in zip(kinds, starts, [*starts[1:], len(word)]):
        first = np.flatnonzero(np.concatenate([[True], word[s + 1:e] != word[s:e - 1]]))
        yield {"chunk": chunk, "bucket": int(b), "words": _raw(word[s:e][first], "<u8"),
               "pairs": _planes(np.diff(first, append=e - s)),
               "contexts": _raw(context[s:e], "<u8"), "counts": _planes(count[s:e])}


def _table(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(),
             "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k])
                                       for n, k in fields], [n for n, _ in fields])


def _array(value, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer() if isinstance(value, pa.Scalar) else value, kind)


class _Bucket:
    """The words of one bucket and their (word, context) pairs with counts over all chunks.

    ``contexts``: the distinct ones' hashes, by part of the context table and then by hash.
    """

    def __init__(self, table: pa.Table, parts: int):
        words = [_array(x, "<u8") for x in table.column("words")]
        pairs = [_unplanes(x.as_py()) for x in table.column("pairs")]
        self.words, place = np.unique(np.concatenate(words), return_inverse=True)
        hashes, at = np.unique(np.concatenate([_array(x, "<u8") for x in table.column("contexts")]),
                               return_inverse=True)
        part = (mixed(hashes) >> np.uint64(24)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        self.contexts, self.part = hashes[order], part[order].astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys = np.repeat(place, np.concatenate(pairs)) * len(order) + rank[at]
        self.keys, where = np.unique(keys, return_inverse=True)
        counts = np.concatenate([_unplanes(x.as_py()) for x in table.column("counts")])
        self.count = np.bincount(where, counts, len(self.keys)).astype(np.int64)
        self.wheres = np.split(where, np.cumsum([p.sum() for p in pairs])[:-1])  # of each chunk's pairs


def _seat(count: np.ndarray, pull: np.ndarray, discount: float, random) -> np.ndarray:
    """Tables after seating ``count`` customers of each dish; ``pull``: what a new table weighs."""
    tables = np.minimum(count, 1)
    order = np.flatnonzero(count > 1)
    order = order[np.argsort(-count[order], kind="stable")]
    tables[order] = _seat_sorted(count[order], pull[order], discount, random)
    return tables


def _seat_sorted(c: np.ndarray, p: np.ndarray, discount: float, random) -> np.ndarray:
    """The same for dishes of two customers or more, the largest first."""
    n = len(c)
    t = np.ones(n)
    seated = 1
    while n:
        step = 1 if seated < 64 else seated // 16
        some = np.minimum(step, c[:n] - seated)
        chance = p[:n] / (seated - discount * t[:n] + p[:n])
        t[:n] += random.random(n) < chance if step == 1 else random.binomial(some, chance)
        seated += step
        n = int(np.searchsorted(-c[:n], -seated, side="left"))
    return t.astype(np.int64)


class _Totals:
    """What all buckets share: customers and tables of the restaurants, vocabulary, discounts.

    ``parent``: all restaurants' tables, if ``tables`` are those of some only. ``elsewhere``: by
    bucket and hot word, the word's customers in the parent that other buckets send.
    """

    def __init__(self, customers, tables, parent_tables, vocabulary, tokens, discounts, parent=None,
                 elsewhere=None):
        self.customers, self.tables = customers, tables
        self.parent_tables, self.vocabulary, self.tokens = parent_tables, vocabulary, tokens
        self.discounts = discounts
        self.parent = tables.sum() if parent is None else parent
        self.elsewhere = elsewhere

    def of(self, customers, tables) -> _Totals:
        """With the totals of some restaurants."""
        return _Totals(customers, tables, self.parent_tables, self.vocabulary, self.tokens,
                       self.discounts, self.parent)


def _sample(word: np.ndarray, context: np.ndarray, count: np.ndarray, n: int, g: _Totals, random,
            sweeps: int, keep: int, hot_at: np.ndarray | None = None,
            elsewhere: np.ndarray | None = None):
    """Seat the words of a bucket; averages over the last ``keep`` sweeps.

    (each pair's count less its tables' discount, the same of each word in the parent, tables by
    context, tables of the parent). With words ``hot_at`` that other buckets send customers of as
    well: those don't count for the parent's tables, and a fifth result is the customers sent.
    """
    some = np.flatnonzero(count > 0)
    w, k, c = word[some], context[some], count[some]
    (s1, s0), (d1, d0) = STRENGTH, g.discounts
    base = 1 / (g.vocabulary + 1)
    many = np.flatnonzero(c > 1)  # a single customer always has one table
    many = many[np.argsort(-c[many], kind="stable")]
    w2, c2, pull = w[many], c[many], (s1 + d1 * g.tables[k[many]])
    open_parent = s0 + d0 * g.parent_tables
    new = np.full(n, open_parent * base)
    tables = np.ones(len(some), np.int64)
    others, mine = np.zeros(n, np.int64), np.ones(n, bool)
    if hot_at is not None:
        others[hot_at], mine[hot_at] = elsewhere, False
    own, mean, sends = np.zeros(len(count)), np.zeros(n), np.zeros(n)
    by_context, of_parent = np.zeros(len(g.tables)), 0.0
    single = np.bincount(w, c == 1, n).astype(np.int64)
    for i in range(sweeps):
        sent = single + np.bincount(w2, tables[many], n).astype(np.int64) + others
        above = _seat(sent, new, d0, random)
        rest = sent[w2] - tables[many]  # the parent without this restaurant's customers of the dish
        left = np.where(rest > 0, rest - d0 * np.minimum(above[w2], rest), 0.0)
        p = (left + open_parent * base) / (s0 + g.parent)
        tables[many] = _seat_sorted(c2, pull * p, d1, random)
        if i >= sweeps - keep:
            sent = single + np.bincount(w2, tables[many], n).astype(np.int64)
            above = _seat(sent + others, new, d0, random)
            mean += (sent - d0 * above) / keep
            own[some] += (c - d1 * tables) / keep
            by_context += np.bincount(k, tables, len(g.tables)) / keep
            of_parent += above[mine].sum() / keep
            sends += sent / keep
    found = own, mean, by_context, of_parent
    return found if hot_at is None else (*found, sends[hot_at])


def _parent(mean: np.ndarray, g: _Totals) -> np.ndarray:
    """Each word's averaged predictive probability in the parent restaurant."""
    s0, d0 = STRENGTH[1], g.discounts[1]
    new = (s0 + d0 * g.parent_tables) / (g.vocabulary + 1)
    return (mean + new) / (s0 + g.parent)


class _Seats:
    """A bucket's row and the context table's answers to it, as ``_sample`` takes them."""

    def __init__(self, table: pa.Table, g: _Totals, kept: int, rng: list[int]):
        part = table.column("part").to_numpy()
        row = table.slice(int(np.flatnonzero(part == OWN)[0]), 1)
        cell = lambda name: row.column(name)[0].as_py()
        self.bucket = cell("bucket")
        pairs = _unplanes(cell("pairs"))
        self.n = len(pairs)
        self.word = np.repeat(np.arange(self.n), pairs)
        self.context, self.count = _unplanes(cell("contexts")), _unplanes(cell("counts"), 8)
        self.hot_at = np.array(cell("hot_at"), np.int64)
        self.hot_words = cell("hot_words")
        others = g.elsewhere.get(self.bucket, {})
        self.elsewhere = np.array([others.get(w, 0) for w in self.hot_words], np.int64)
        # answers one part after the other: in the order of the bucket's contexts
        messages = table.filter(pa.array(part >= 0)).sort_by("part")
        self.parts = messages.column("part").to_pylist()
        self.customers = self.tables = None
        for name, scale in (("tables", kept), ("customers", 1)):
            found = messages.column(name).drop_null().to_pylist() if name in messages.column_names else []
            if found:
                x, self.cut = _joined(found, 8)
                setattr(self, name, x / scale)
        self.messages, self.g, self.rng = messages, g.of(self.customers, self.tables), rng

    def sample(self, sweeps: int, keep: int):
        random = np.random.default_rng([*self.rng, self.bucket])
        return _sample(self.word, self.context, self.count, self.n, self.g, random, sweeps, keep,
                       self.hot_at, self.elsewhere)


def _adding(kept_index: bool):
    """Adds up the messages to a part of the context table, and answers each.

    The first messages name contexts by hash and also tell customers; later ones name them by the
    place in the part that the first answer told.
    """
    def add(table: pa.Table) -> pa.Table:
        col = lambda name: table.column(name).to_pylist()
        tables, cut = _joined(col("tables"), 8)
        if kept_index:
            at = np.concatenate([np.cumsum(_unplanes(x)) for x in col("index")])
        else:
            _, at = np.unique(np.concatenate([_array(x, "<u8") for x in col("hashes")]), return_inverse=True)
        opened = np.bincount(at, tables).astype(np.int64)
        ats = np.split(at, cut)
        index = col("index") if kept_index else [_planes(np.diff(a, prepend=0)) for a in ats]
        rows = [{"bucket": b, "part": p, "index": i, "tables": _planes(opened[a], 8)}
                for b, p, i, a in zip(col("bucket"), col("part"), index, ats)]
        if not kept_index:
            taken = np.bincount(at, _joined(col("customers"), 8)[0]).astype(np.int64)
            for r, a in zip(rows, ats):
                r["customers"] = _planes(taken[a], 8)
        return pa.Table.from_batches([_table(rows, M_SCHEMA)])

    return add


class _Tables:
    """Intermediate tables that nothing returned reads: stored without leaving the shuffle files of
    the write behind, and dropped when the next ones are written. Only for frames read from
    stored tables."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        was, path = conf.get(key, "false"), fresh_path(self.spark, name)
        conf.set(key, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(key, was)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[found] = path
        return found

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for f in frames:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(f))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _hot_words(docs: DataFrame, total: int, buckets: int) -> dict[int, int]:
    """Words of more than a bucket's share of the tokens (fewer than there are buckets), from a
    sample of texts, and over how many buckets each is dealt. Decides the layout only."""
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(-(-total // SAMPLE_BYTES))) == 0)

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column("text"))
            for part in batches_of([len(t) for t in texts], BATCH_BYTES):
                token, _ = _tokens(texts[part])
                words, n = np.unique(token, return_counts=True)
                yield _table([{"word": w, "n": c, "all": len(token) * (i == 0)} for i, (w, c) in enumerate(zip(
                    words.view(np.int64).tolist(), n.tolist())) if i == 0 or c * 4 * buckets > len(token)],
                    "word long, n long, all long")

    found = stored(some.mapInArrow(tidy(run), "word long, n long, all long"), "frequent")
    tokens = found.agg(F.sum("all")).first()[0] or 0
    hot = (found.groupBy("word").agg(F.sum("n").alias("n"))
           .where(F.col("n") * buckets > tokens).collect())  # fewer than buckets
    return {r["word"] % (1 << 64): -(-r["n"] * buckets // tokens) + 1 for r in hot}


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


def score(docs: DataFrame, held_out: Column, epochs: int = EPOCHS, burn_in: int = BURN_IN,
          samples: int = SAMPLES, seed: int = SEED, chunk_tokens: int = CHUNK_TOKENS,
          bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """S_SCHEMA with train_tokens and perplexity (under the model) for every document.

    Learned from the rows for which the condition ``held_out`` does not hold.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))

    parts = max(1, buckets // 8)  # of the context table
    layout = _Layout(buckets, _hot_words(docs, total, buckets) if buckets > 1 else {})

    def cut(batches):
        chunk, kept, size = TaskContext.get().partitionId() << 33, [], 0
        for b in batches:
            texts = text_bytes(b.column("text"))
            ids, held = b.column("doc_id").to_pylist(), b.column("held").to_pylist()
            for part in batches_of([len(t) for t in texts], BATCH_BYTES):
                token, counts = _tokens(texts[part])
                kept += zip(ids[part], held[part], np.split(token, np.cumsum(counts)[:-1]))
                size += len(token)
                if size >= chunk_tokens:
                    yield _table([_chunk(chunk, kept)], A_SCHEMA)
                    chunk, kept, size = chunk + 1, [], 0
        if kept:
            yield _table([_chunk(chunk, kept)], A_SCHEMA)

    rows = stored(docs.mapInArrow(tidy(cut), A_SCHEMA), "chunks")

    def send(batches):
        for b in batches:
            for r in range(b.num_rows):
                cell = lambda n: b.column(n)[r]  # noqa: B023, E731
                yield _table(list(_sendings(
                    cell("chunk").as_py(), _array(cell("words"), "<u8"), _unplanes(cell("tokens").as_py()),
                    _array(cell("lengths"), "<i8"), np.array(cell("held").as_py(), bool), layout)), P_SCHEMA)

    def count(table: pa.Table) -> pa.Table:
        b = _Bucket(table, parts)
        bucket = table.column("bucket")[0].as_py()
        word, context = b.keys // len(b.contexts), b.keys % len(b.contexts)
        opened = np.bincount(word, b.count > 0, len(b.words)).astype(np.int64)
        of_word = np.bincount(word, b.count, len(b.words)).astype(np.int64)
        hot = layout.is_hot(b.words)
        out = [{"bucket": bucket, "part": WHERE, "chunk": c, "places": _planes(x)}
               for c, x in zip(table.column("chunk").to_pylist(), b.wheres)]
        out.append({
            "bucket": bucket, "part": OWN, "pairs": _planes(np.bincount(word, minlength=len(b.words))),
            "contexts": _planes(context), "counts": _planes(b.count, 8),
            "words": int((of_word[~hot] > 0).sum()), "opened": int(opened.sum()), "taken": int(of_word.sum()),
            "ones": int((b.count == 1).sum()), "twos": int((b.count == 2).sum()),
            "hot_at": np.flatnonzero(hot), "hot_words": b.words[hot].view(np.int64),
            "hot_sent": opened[hot].astype(float), "hot_count": of_word[hot]})
        tables = np.bincount(context, b.count > 0, len(b.contexts)).astype(np.int64)
        customers = np.bincount(context, b.count, len(b.contexts)).astype(np.int64)
        to, starts = np.unique(b.part, return_index=True)
        out += [{"bucket": bucket, "part": int(p), "hashes": _raw(b.contexts[s:e], "<u8"),
                 "tables": _planes(tables[s:e], 8), "customers": _planes(customers[s:e], 8)}
                for p, s, e in zip(to, starts, [*starts[1:], len(b.part)])]
        return pa.Table.from_batches([_table(out, C_SCHEMA)])

    tables = _Tables(spark)
    counted = tables.write(rows.mapInArrow(tidy(send), P_SCHEMA).repartition(buckets, "bucket")
                           .groupBy("bucket").applyInArrow(count, C_SCHEMA), "counts")
    state = counted.where(F.col("part") == OWN).select(
        "bucket", "part", "pairs", "contexts", "counts", "hot_at", "hot_words")

    def added(messages: DataFrame, kept_index: bool) -> DataFrame:
        return tables.write(messages.repartition(parts, "part").groupBy("part")
                            .applyInArrow(_adding(kept_index), M_SCHEMA), "contexts")

    first = added(counted.where(F.col("part") >= 0).select(
        "bucket", "part", "hashes", "tables", "customers"), False)

    def hot_rows(frame: DataFrame, *names: str) -> list:
        """A row for each hot word of each bucket it is dealt to: in all a few times the buckets."""
        return (frame.where(F.col("part") == OWN).select("bucket", F.explode(F.arrays_zip(*names)).alias("x"))
                .select("bucket", "x.*").orderBy("hot_words", "bucket").collect())

    def dealt(found: list) -> tuple[dict, dict]:
        """Each hot word's customers in the parent, and what buckets other than each send of it."""
        sent, elsewhere = {}, {}
        for r in found:
            sent[r["hot_words"]] = sent.get(r["hot_words"], 0) + r["hot_sent"]
        for r in found:
            if r["hot_sent"]:
                elsewhere.setdefault(r["bucket"], {})[r["hot_words"]] = int(sent[r["hot_words"]] - r["hot_sent"])
        return sent, elsewhere

    one = counted.where(F.col("part") == OWN).agg(*[
        F.sum(c).alias(c) for c in ("words", "opened", "taken", "ones", "twos")]).first()
    hot = hot_rows(counted, "hot_words", "hot_sent", "hot_count")
    hot_count = {}
    for r in hot:
        hot_count[r["hot_words"]] = hot_count.get(r["hot_words"], 0) + r["hot_count"]
    vocabulary = (one["words"] or 0) + sum(c > 0 for c in hot_count.values())
    # from the pairs seen once and twice; the parent takes the same
    d = _discount(one["ones"] or 0, one["twos"] or 0)
    totals = _Totals(None, None, vocabulary * 1.0, vocabulary, one["taken"] or 0, (d, d),
                     one["opened"] or 0, dealt(hot)[1])

    def seated(g: _Totals, answers: DataFrame, kept: int, epoch: int, sweeps: int, keep: int):
        """The totals that a seating of all buckets, given the totals ``g``, leaves; the context
        table's answers (sums of ``keep`` seatings); hot words' discounted customers in the parent."""
        def sweep(table: pa.Table) -> pa.Table:
            b = _Seats(table, g, kept, [seed, epoch])
            _, _, by_context, above, sends = b.sample(sweeps, keep)
            out = [{"bucket": b.bucket, "part": OWN, "opened": by_context.sum(), "above": above,
                    "hot_words": b.hot_words, "hot_sent": sends}]
            out += [{"bucket": b.bucket, "part": p, "index": i, "tables": _planes(np.rint(x * keep), 8)}
                    for p, i, x in zip(b.parts, b.messages.column("index").to_pylist(),
                                       np.split(by_context, b.cut))]
            return pa.Table.from_batches([_table(out, T_SCHEMA)])

        after = tables.write(state.unionByName(answers, allowMissingColumns=True)
                             .repartition(buckets, "bucket").groupBy("bucket")
                             .applyInArrow(sweep, T_SCHEMA), "seating")
        own = after.where(F.col("part") == OWN).agg(F.sum("opened"), F.sum("above")).first()
        sent, elsewhere = dealt(hot_rows(after, "hot_words", "hot_sent"))
        words = sorted(sent)
        sends = np.array([sent[w] for w in words], float)
        new = (STRENGTH[1] + d * g.parent_tables) / (vocabulary + 1)
        above = _seat(np.rint(sends).astype(np.int64), np.full(len(words), new), d,
                      np.random.default_rng([seed, epoch]))
        after_all = added(after.where(F.col("part") >= 0).select("bucket", "part", "index", "tables"), True)
        tables.drop(after)
        return (_Totals(None, None, (own[1] or 0.0) + float(above.sum()), vocabulary, g.tokens, g.discounts,
                        own[0] or 0.0, elsewhere), after_all, dict(zip(words, sends - d * above)))

    answers = first
    for epoch in range(epochs):
        last, (totals, answers, _) = answers, seated(totals, answers.drop("customers"), 1, epoch, burn_in, 1)
        if last is not first:
            tables.drop(last)
    # the seating that is averaged: once for its totals, once more (from the same numbers) for
    # the words, so that probabilities sum to one
    before, given = totals, answers
    g, answers, hot_mean = seated(before, given.drop("customers"), 1, epochs, burn_in + samples, samples)

    def answer(table: pa.Table) -> pa.Table:
        part, final = table.column("part").to_numpy(), np.array(table.column("final").to_pylist(), object)
        pick = lambda keep: table.filter(pa.array(keep))
        b = _Seats(pick((part == OWN) | ((part >= 0) & (final == 0))), before, 1, [seed, epochs])
        own, mean, _, _, _ = b.sample(burn_in + samples, samples)
        of_word = np.bincount(b.word, b.count, b.n).astype(np.int64)
        for at, w in zip(b.hot_at, b.hot_words):  # parts of it lie elsewhere
            mean[at], of_word[at] = hot_mean.get(w, 0.0), hot_count[w]
        b.g = _Seats(pick((part == OWN) | ((part >= 0) & (final > 0))), g, samples, []).g
        (s1, _), (d1, _) = STRENGTH, g.discounts
        k = b.context
        p = (own + (s1 + d1 * b.g.tables[k]) * _parent(mean, g)[b.word]) / (s1 + b.g.customers[k])
        places = pick(part == WHERE)
        out = []
        for c, raw in zip(places.column("chunk").to_pylist(), places.column("places").to_pylist()):
            x = _unplanes(raw)
            out.append({"chunk": c, "bucket": b.bucket, "known": _planes(of_word[b.word[x]], 8),
                        "p": _raw(p[x], "<f4")})
        return pa.Table.from_batches([_table(out, R_SCHEMA)])

    def with_final(frame: DataFrame, final: int) -> DataFrame:
        return frame.withColumn("final", F.lit(final))

    asked = with_final(state, 0)
    for frame in (with_final(given.drop("customers"), 0), with_final(answers.drop("customers"), 1),
                  with_final(first.drop("tables"), 1),
                  with_final(counted.where(F.col("part") == WHERE).select("bucket", "part", "chunk", "places"), 0)):
        asked = asked.unionByName(frame, allowMissingColumns=True)
    answered = tables.write(asked.repartition(buckets, "bucket").groupBy("bucket")
                            .applyInArrow(answer, R_SCHEMA), "answers")
    tables.drop(counted, answers, *{first, given})

    def add_up(key, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        p = np.concatenate([_array(x, "<f4") for x in right.column("p")]).astype(float)
        known, _ = _joined(right.column("known").to_pylist(), 8)
        lengths = _array(left.column("lengths")[0], "<i8")
        _, _, _, at = _pairs(_array(left.column("words")[0], "<u8"),
                             _unplanes(left.column("tokens")[0].as_py()), lengths, layout)
        first = np.cumsum(lengths) - lengths
        c = known[at]
        plain = np.log10((c + 0.1) / (g.tokens + 0.1 * (g.vocabulary + 1)))
        return pa.table({
            "doc_id": left.column("doc_ids").combine_chunks().flatten(),
            "held_out": left.column("held").combine_chunks().flatten(),
            "n_tokens": pa.array(lengths), "n_known": np.add.reduceat((c > 0).astype(np.int64), first),
            "base_score": np.add.reduceat(plain, first), "score": np.add.reduceat(np.log10(p[at]), first)})

    found = rows.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(add_up, S_SCHEMA)
    return (found.withColumn("train_tokens", F.lit(g.tokens).cast("long"))
            .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))


def op6_pitman_yor(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows whose id's crc32 is divisible by 10 are held out."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return score(documents(spark, sf_dir), held).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
