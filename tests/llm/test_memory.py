"""What the operators' helpers hold at once, whatever the batch they are given."""

import tracemalloc

import numpy as np
import pyarrow as pa

from vacancy_spark.llm import near_duplicates, packing, suffix_dedup, toxicity


def peak_mb(run):
    run()  # what is kept for later calls is made first
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def prose(size):
    rng = np.random.default_rng(3)
    letters = rng.integers(97, 123, size).astype(np.uint8)
    letters[rng.random(size) < 0.18] = 0x20
    return [letters[a:a + 4000].tobytes() for a in range(0, size, 4000)]


def test_texts_handled_at_once_take_little_memory():
    size = 1 << 18
    machine = toxicity.Machine(0.0, np.zeros(size, np.float32),
                               np.zeros((size, toxicity.FACTORS), np.float32))
    texts = prose(toxicity.BATCH_BYTES)
    assert peak_mb(lambda: machine.scores(texts)) < 30
    texts = prose(near_duplicates.BATCH_BYTES)
    assert peak_mb(lambda: near_duplicates.shingle_sets(texts)) < 30
    texts = prose(suffix_dedup.BATCH_BYTES)
    assert peak_mb(lambda: suffix_dedup.pieces(texts, 200)) < 40


def test_a_block_is_compared_in_a_small_table():
    sets = np.arange(512 * 16, dtype=np.uint64).reshape(512, 16).repeat(2, axis=0).reshape(-1)  # two of each
    found = []
    assert peak_mb(lambda: found.append(near_duplicates.compare_block(
        sets, np.full(1024, 16), np.arange(1024), np.arange(1024), 0.8))) < 50
    assert sorted(zip(*map(np.ndarray.tolist, found[0]))) == [
        (x, y) for x in range(1024) for y in (x & ~1, x | 1)]


class Encoder:
    """One id for each character, and the most characters asked for at once."""

    most = 0

    def encode(self, texts):
        self.most = max(self.most, sum(len(t or "") for t in texts))
        counts = np.array([len(t or "") for t in texts], np.int64)
        return np.concatenate([np.zeros(0, np.uint32), *(np.full(k, 7, np.uint32) for k in counts)]), counts


def test_a_batch_is_encoded_some_texts_at_a_time():
    texts = ["a" * 200_000 if i % 3 else None for i in range(30)] + ["", "b" * 1_500_000]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, len(texts))], pa.int64()), pa.array(texts)],
                                       ["doc_id", "text"])
    encoder = Encoder()
    rows = pa.Table.from_batches(packing._cut(batch, encoder, 4096, 1)).to_pylist()
    assert encoder.most == 1_500_000  # the long text stands alone
    lengths = {}
    for r in rows:
        assert r["start"] == 4096 * r["piece"] == lengths.get(r["doc_id"], 0)
        lengths[r["doc_id"]] = r["start"] + r["length"]
    assert lengths == {i or None: len(t or "") + 1 for i, t in enumerate(texts)}
    assert list(lengths) == [None, *range(1, len(texts))]
    empty = batch.slice(0, 0)
    assert not list(packing._cut(empty, encoder, 4096, 1))
