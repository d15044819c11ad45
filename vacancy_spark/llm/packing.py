"""Packing of documents into sequences of bounded length: best fit, then a swap-based search.

Every document is encoded and only those longer than a sequence are cut. Pieces that fill a
sequence are done; the others are dealt by hash into groups of bounded size. A group is packed
best fit, largest first. Then its emptiest bin tries to give its pieces to the other underfull
bins, by moving one piece, exchanging one for one or two for one, each step raising the sum of
squared fills, until the bin is empty; then the next emptiest, until one cannot be emptied.
A second round treats the bins that stayed underfull in all groups in the same way.

Null texts are empty documents, which hold the end id alone. Ids may be null or repeat: pieces
are told apart by a number of their own. Extra columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancy_spark.llm._encode import ChunkEncoder, keeps_space, vocabulary_path, worker_encoder
from vacancy_spark.llm._shared import documents, hand_back, narrow_batches, stored, tidy
from vacancy_spark.llm._words import batches_of

CAPACITY = 4096
GROUP_PIECES = 20_000
BATCH_CHARS = 1 << 20  # characters of texts that are encoded at once
TASK_CHUNKS = 100_000  # distinct chunks that an encoder of one task keeps
UNDERFULL = 0.98  # bins filled less than this take part in the second round

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", piece_no long, sequence_id long, offset long, fill long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "word_bpe_49k.json",
           end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
           keep_encoder: bool = False) -> DataFrame:
    """The pieces of every document's ids (its text's, then ``end_id``).

    ``keep_encoder``: a Python worker keeps its encoder for its next tasks, and the memory with it.
    """
    narrow_batches(docs.sparkSession)

    def cut(batches):
        path, space = vocabulary_path(vocabulary), keeps_space(vocabulary)
        encoder = worker_encoder(path, space) if keep_encoder else ChunkEncoder(path, space, TASK_CHUNKS)
        for b in batches:
            yield from _cut(b, encoder, capacity, end_id)
            hand_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text")).mapInArrow(tidy(cut), PIECES)


def _cut(b: pa.RecordBatch, encoder: ChunkEncoder, capacity: int, end_id: int):
    """The pieces of a batch of doc_id and text; no more than BATCH_CHARS (or one text) are encoded at once."""
    texts = b.column("text").to_pylist()
    for part in batches_of([len(t or "") for t in texts], BATCH_CHARS):
        ids, counts = encoder.encode(texts[part])
        ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
        counts = counts + 1
        n = -(-counts // capacity)
        doc = np.repeat(np.arange(len(counts)), n)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(counts[doc] - start, capacity)
        at = (np.cumsum(counts) - counts)[doc] + start
        crc = [zlib.crc32(ids[a:a + k].data) for a, k in zip(at, length)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(pa.array(part.start + doc)), pa.array(piece, pa.int32()),
             pa.array(start, pa.int64()), pa.array(length, pa.int64()),
             pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece indexes: each piece, largest first, goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set when some bin has room r
    for i in np.argsort(-lengths, kind="stable"):
        k = int(lengths[i])
        fitting = rooms >> k
        if fitting:
            room = k + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(int(i))
        if room > k:
            by_room[room - k].append(b)
            rooms |= 1 << (room - k)
    return bins


def _best_step(give: np.ndarray, take: np.ndarray, room: int, gain_over: int):
    """The exchange that fills ``room`` best: (indexes given, index taken or None), or None.

    ``gain_over``: an exchange of net size d raises the sum of squared fills when d exceeds it.
    """
    best, step = gain_over, None
    fit = np.where(give <= room, give, -1)
    if len(fit) and fit.max() > best:
        best, step = int(fit.max()), ((int(fit.argmax()),), None)
    if best < room and len(take) and len(give):
        d = give[:, None] - take[None, :]
        d = np.where(d <= room, d, -1)
        if d.max() > best:
            a, b = divmod(int(d.argmax()), len(take))
            best, step = int(d.max()), ((a,), b)
    if best < room and len(take) and len(give) > 1:
        x, y = np.triu_indices(len(give), 1)
        d = (give[x] + give[y])[:, None] - take[None, :]
        d = np.where(d <= room, d, -1)
        if d.max() > best:
            a, b = divmod(int(d.argmax()), len(take))
            best, step = int(d.max()), ((int(x[a]), int(y[a])), b)
    return step


def swap_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty the emptiest bins by moves and exchanges that raise the sum of squared fills."""
    fill = {b: int(lengths[x].sum()) for b, x in enumerate(bins)}
    bins = {b: list(x) for b, x in enumerate(bins)}
    while True:
        under = sorted((f, b) for b, f in fill.items() if f < capacity)
        if len(under) < 2:
            break
        low = under[0][1]
        rest = [b for _, b in under[:0:-1]]  # fullest first
        if sum(capacity - fill[b] for b in rest) < fill[low]:
            break  # not all of it has room elsewhere
        moved = True
        while bins[low] and moved:
            moved = False
            for b in rest:
                while bins[low] and fill[b] < capacity:
                    step = _best_step(lengths[bins[low]], lengths[bins[b]], capacity - fill[b],
                                      max(0, fill[low] - fill[b]))
                    if step is None:
                        break
                    given = [bins[low][i] for i in step[0]]
                    taken = [] if step[1] is None else [bins[b][step[1]]]
                    bins[low] = [i for i in bins[low] if i not in given] + taken
                    bins[b] = [i for i in bins[b] if i not in taken] + given
                    d = int(lengths[given].sum() - lengths[taken].sum())
                    fill[low] -= d
                    fill[b] += d
                    moved = True
                if not bins[low]:
                    break
        if bins[low]:
            break  # raised the squared fills as far as it goes, but the bin stays
        del bins[low], fill[low]
    return list(bins.values())


def _packed(length: np.ndarray, capacity: int, first: int) -> tuple[np.ndarray, ...]:
    """Sequence, offset in it and its fill for each piece."""
    bins = swap_search(best_fit(length, capacity), length, capacity)
    sequence, offset, fill = (np.zeros(len(length), np.int64) for _ in range(3))
    for s, x in enumerate(bins):
        k = length[x]
        sequence[x], offset[x], fill[x] = first + s, np.cumsum(k) - k, k.sum()
    return sequence, offset, fill


def _round(rows: DataFrame, capacity: int, groups: int, tag: int) -> DataFrame:
    """Pack rows (PACKED) group by group; a group that gains no bin keeps what it had."""
    def pack(table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        old = np.unique(table.column("sequence_id").to_numpy())
        first = (tag << 56) + (table.column("shard")[0].as_py() << 32)
        found = _packed(length, capacity, first)
        out = table.select([f.split()[0] for f in PACKED.split(", ")])
        if tag > 1 and len(np.unique(found[0])) >= len(old):
            return out
        for name, x in zip(("sequence_id", "offset", "fill"), found):
            out = out.set_column(out.column_names.index(name), name, pa.array(x, pa.int64()))
        return out

    # whole bins go to one group: in the first round each piece is a bin of its own
    return (rows.withColumn("shard", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
            .groupBy("shard").applyInArrow(pack, PACKED))


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "word_bpe_49k.json",
         end_id: int = 1, group_pieces: int = GROUP_PIECES, **columns) -> DataFrame:
    """PIECES and sequence_id, offset: every piece's place in a sequence of ``capacity`` ids."""
    rows = stored(pieces(docs, capacity, vocabulary, end_id, **columns)
                  .withColumn("piece_no", F.monotonically_increasing_id()), "pieces")
    rows = (rows.withColumn("sequence_id", -1 - F.col("piece_no"))
            .withColumn("offset", F.lit(0).cast("long")).withColumn("fill", F.col("length")))
    full, part = rows.where(F.col("length") == capacity), rows.where(F.col("length") < capacity)
    first = stored(_round(part, capacity, -(-part.count() // group_pieces) or 1, 1), "packed")
    # a mixed remainder: the bins that no group could fill, put together anew
    under = F.col("fill") < int(UNDERFULL * capacity)
    left = first.where(under)
    second = _round(left, capacity, -(-left.count() // group_pieces) or 1, 2)
    names = [f.split()[0] for f in PIECES.split(", ")] + ["sequence_id", "offset"]
    return (full.select(names).unionByName(first.where(~under).select(names))
            .unionByName(second.select(names)))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids of word_bpe_49k.json."""
    return pack(documents(spark, sf_dir), keep_encoder=True)
