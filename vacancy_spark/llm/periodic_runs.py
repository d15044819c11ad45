"""Periodic runs of words, found by recompression.

A text's words become numbers and a run-length grammar is built over them by recompression: block
compression (each maximal stretch of one symbol becomes a symbol for it and its length) and pair
compression (the symbols are split in two halves, and each left one followed by a right one becomes
a symbol for both) take turns until no symbol occurs twice. Equal stretches are cut alike but for
a few symbols at their ends, so how far two places agree is found by climbing the levels of the
grammar while they agree and descending where they part.

A run of period q and length max(least, times * q) or more agrees with itself q further on for
max(least, times * q) - q words, so it holds a multiple of that number: for every q, the places
of this harmonic grid are the candidates. Where a candidate's word equals the one q further on,
the grammar says exactly how far both sides agree, forwards and backwards, which is the run that
holds it. Of the periods found for one stretch the smallest is its own (any other is a multiple).

Words are compared as they are, byte by byte, and never across texts. A null text is empty; null
and repeated ids are passed on as they are; an empty table gives no rows; other columns are
ignored, whatever their names. A text is handled in one task, some 300 bytes of memory a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancy_spark.llm._shared import documents, narrow_batches
from vacancy_spark.llm._words import Words, batches_of, text_bytes

LEAST = 24  # words in a run
TIMES = 3  # periods in a run
BATCH_BYTES = 2 << 20  # texts that share one grammar
GRID_ROWS = 4_000_000  # candidates looked at together
RUN = "struct<start:long,length:long,period:long>"
FOUND = f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string"


class Level:
    """The symbols of one level and how they make up the next one.

    ``bounds``: the first symbol of each symbol of the next level, and the end; ``parent``: the
    symbol of the next level that each belongs to. ``blocks``: whether symbols of one parent
    are equal (block compression). The last level has neither.
    """

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray | None = None, blocks: bool = False):
        self.symbols, self.bounds, self.blocks = symbols, bounds, blocks
        if bounds is not None:
            self.parent = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def reversed(self) -> Level:
        out = Level(self.symbols[::-1])
        out.blocks = self.blocks
        if self.bounds is not None:
            out.bounds = len(self.symbols) - self.bounds[::-1]
            out.parent = len(self.bounds) - 2 - self.parent[::-1]
        else:
            out.bounds = None
        return out

    def step(self, a: np.ndarray, b: np.ndarray) -> np.ndarray | int:
        """How many symbols agree from places on whose symbols are equal, without a further look."""
        if not self.blocks:
            return 1
        return np.minimum(self.bounds[self.parent[a] + 1] - a, self.bounds[self.parent[b] + 1] - b)

    def begins(self, a: np.ndarray) -> np.ndarray:
        return self.bounds[self.parent[a]] == a


def grammar(symbols: np.ndarray, seed: int = 1) -> list[Level]:
    """The levels of a run-length grammar for ``symbols`` (numbers from 0), by recompression."""
    rng = np.random.default_rng(seed)
    levels, fresh = [], int(symbols.max(initial=-1)) + 1
    while len(symbols) and np.bincount(symbols, minlength=fresh).max() > 1:
        n = len(symbols)
        bounds = np.concatenate([[0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1, [n]])
        if len(bounds) - 1 < n:
            lengths = np.diff(bounds)
            new, many = symbols[bounds[:-1]], np.flatnonzero(lengths > 1)
            kinds, name = np.unique(new[many] * (n + 1) + lengths[many], return_inverse=True)
            levels.append(Level(symbols, bounds, blocks=True))
            new[many] = fresh + name
            symbols, fresh, n = new, fresh + len(kinds), len(new)
        left = rng.integers(0, 2, fresh, dtype=np.int8)[symbols]
        turn = left[:-1] - left[1:]  # 1: left, right; -1: right, left
        first = np.flatnonzero(turn == (1 if np.count_nonzero(turn == 1) * 2 >= np.count_nonzero(turn) else -1))
        if not len(first):
            continue
        kept = np.ones(n, bool)
        kept[first + 1] = False
        bounds = np.append(np.flatnonzero(kept), n)
        kinds, name = np.unique(symbols[first] * fresh + symbols[first + 1], return_inverse=True)
        levels.append(Level(symbols, bounds))
        symbols = symbols[bounds[:-1]]
        symbols[levels[-1].parent[first]] = fresh + name
        fresh += len(kinds)
    return [*levels, Level(symbols)]


def extensions(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols of the lowest level agree from each ``a`` and its ``b`` on (a differs
    from b, and the last symbol occurs once)."""
    out = np.zeros(len(a), np.int64)
    parted: list[list[tuple]] = [[] for _ in levels]
    which, from_a, last = np.arange(len(a)), a, len(levels) - 1
    for t, level in enumerate(levels):
        climbed = []
        while len(which):
            same = level.symbols[a] == level.symbols[b]
            parted[t].append((which[~same], a[~same], b[~same]))
            which, a, b = which[same], a[same], b[same]
            if t < last:
                up = level.begins(a) & level.begins(b)
                climbed.append((which[up], level.parent[a[up]], level.parent[b[up]]))
                which, a, b = which[~up], a[~up], b[~up]
            step = level.step(a, b)
            a, b = a + step, b + step
        if climbed:
            which, a, b = (np.concatenate(x) for x in zip(*climbed))
    for t in range(last, -1, -1):
        level = levels[t]
        which, a, b = (np.concatenate(x) for x in zip(*parted[t])) if parted[t] else (a[:0],) * 3
        done = []
        while len(which):  # symbols that part may still begin alike
            same = level.symbols[a] == level.symbols[b]
            done.append((which[~same], a[~same], b[~same]))
            which, a, b = which[same], a[same], b[same]
            step = level.step(a, b)
            a, b = a + step, b + step
        if done:
            which, a, b = (np.concatenate(x) for x in zip(*done))
        if t:
            below = levels[t - 1].bounds
            parted[t - 1].append((which, below[a], below[b]))
        else:
            out[which] = a - from_a[which]
    return out


def _grid(counts: np.ndarray, least: int, times: int):
    """Blocks of (text, period, place in the text) of the harmonic grid of each text."""
    periods = np.where(counts >= least, counts // times, 0)
    doc = np.repeat(np.arange(len(counts)), periods)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    width = np.maximum(least, times * period) - period
    places = (counts[doc] - period - 1) // width + 1
    ends = np.cumsum(places)
    at = 0
    while at < len(doc):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + GRID_ROWS, "right")))
        rows = np.repeat(np.arange(at, to), places[at:to])
        k = np.arange(len(rows)) - np.repeat(ends[at:to] - places[at:to] - base, places[at:to])
        yield doc[rows], period[rows], k * width[rows]
        at = to


def runs_of(words: np.ndarray, counts: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(text, start, length, period) of all runs, in this order. ``words``: numbers from 0 of the
    words of texts of ``counts`` words, one after the other."""
    if times < 2 or least < 1:
        raise ValueError("a run has two periods or more")
    n = len(counts)
    first = np.cumsum(counts + 1) - counts  # a border, which occurs once, stands between texts
    symbols = np.zeros(len(words) + n + 1, np.int64)
    border = np.append(first - 1, len(symbols) - 1)
    inner = np.ones(len(symbols), bool)
    inner[border] = False
    symbols[inner] = words
    symbols[border] = words.max(initial=-1) + 1 + np.arange(n + 1)
    levels = grammar(symbols)
    mirror = [x.reversed() for x in levels]
    found = [np.zeros((0, 4), np.int64)]
    for doc, period, place in _grid(counts, least, times):
        a = first[doc] + place
        same = np.flatnonzero(symbols[a] == symbols[a + period])
        doc, period, a = doc[same], period[same], a[same]
        after = extensions(levels, a, a + period)
        before = extensions(mirror, len(symbols) - a, len(symbols) - a - period)
        length = before + after + period
        long = np.flatnonzero(length >= np.maximum(least, times * period))
        rows = np.stack([doc, a - before - first[doc], length, period], 1)[long]
        found.append(_smallest(rows))
    rows = _smallest(np.concatenate(found))
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _smallest(rows: np.ndarray) -> np.ndarray:
    """One row for each stretch: the one of smallest period."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1))] if len(rows) else rows


def _numbered(w: Words) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(w.start), [
        None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(w.data[w.inside]))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _joined(w: Words, source: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts of the words ``source``, joined by one space; ``first``: where each text begins."""
    size = w.end[source] - w.start[source] + 1
    filled = np.flatnonzero(np.diff(first))
    size[first[filled + 1] - 1] -= 1  # no space after a text's last word
    ends = np.cumsum(size)
    spaced = np.where(w.inside, w.data, np.uint8(0x20))
    data = spaced[np.arange(size.sum()) + np.repeat(w.start[source] - ends + size, size)]
    bounds = np.concatenate([[0], ends])[first].astype(np.int32)
    return pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(bounds), pa.py_buffer(data))


def _structs(rows: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in (1, 2, 3)],
                                      ["start", "length", "period"])


def _found(ids: list, texts: list[bytes], arrange, least: int, times: int) -> pa.RecordBatch:
    w = Words(texts, hashes=False)
    n, counts = len(texts), w.counts
    source = np.arange(len(w.start))
    for d in range(n) if arrange else ():
        order = arrange(ids[d], int(counts[d]))
        if order is not None:
            source[w.first[d]:w.first[d + 1]] = w.first[d] + order
    runs = runs_of(_numbered(w)[source], counts, least, times)
    cover = np.zeros(len(source) + 1, np.int64)  # what follows a run's first period goes
    start = w.first[runs[:, 0]] + runs[:, 1]
    np.add.at(cover, start + runs[:, 3], 1)
    np.add.at(cover, start + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    by_doc = np.searchsorted(runs[:, 0], np.arange(n + 1))
    best = [max(range(a, b), key=lambda i: (Fraction(int(runs[i, 2]), int(runs[i, 3])), -i))
            if b > a else None for a, b in zip(by_doc, by_doc[1:])]
    no_run = np.array([b is None for b in best], bool)
    top = runs[[b for b in best if b is not None]] if len(runs) else runs
    whole = _structs(top).take(pa.array(np.where(no_run, 0, np.cumsum(~no_run) - 1), mask=no_run))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array(counts.astype(np.int64)),
        pa.ListArray.from_arrays(pa.array(by_doc.astype(np.int32)), _structs(runs)), whole,
        _joined(w, source[kept], np.searchsorted(kept, w.first))],
        ["doc_id", "n_words", "runs", "best", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str | Column = "text",
                  arrange: Callable[[int | None, int], np.ndarray | None] | None = None,
                  least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs, best, collapsed: the runs of each text, by start, then period.

    A run is a longest stretch of words of smallest period q with max(least, times * q) words or
    more. ``best`` is the one of most periods (ties: smallest start, then period; null without
    a run). ``collapsed`` are the words, joined by one space, without those that a run holds
    after its first period. ``arrange`` gives, for a text's id and number of words, the words to
    read in its place, by number, as many (None: as they are).
    """
    spark = docs.sparkSession
    narrow_batches(spark)

    def find(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), text_bytes(b.column(1))
            for part in batches_of(np.array([len(t) for t in texts]), BATCH_BYTES):
                yield _found(ids[part], texts[part], arrange, least, times)

    text = F.col(text) if isinstance(text, str) else text
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(find, FOUND)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's test words: every tenth text (by the hash of its id) repeats its own words."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Digests of the runs of all documents and of what is left without them."""
    found = periodic_runs(documents(spark, sf_dir), arrange=planted)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                              F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
