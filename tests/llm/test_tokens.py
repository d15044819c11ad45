"""Token counts, token files and packing against the library asked for each whole text."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from llm.conftest_llm import SF, odd_rows

from vacancy_spark.llm import packing, token_counts, token_files
from vacancy_spark.llm import _encode
from vacancy_spark.llm._encode import ChunkEncoder, keeps_space, vocabulary_path


def library(name):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path(name))
    return lambda t: lib.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(name):
    rng = random.Random(4)
    parts = [*"ab,. \n\n  '!_1\tΣé́A\x85\x1c\x00|　", " ", ",", ". ", ".\n", "'s", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    texts += [t for _, t, *_ in odd_rows()]
    ask, encoder = library(name), ChunkEncoder(vocabulary_path(name), keeps_space(name), cache_chunks=500)
    for a in range(0, len(texts), 700):
        flat, counts = encoder.encode(texts[a:a + 700])
        for t, ids in zip(texts[a:a + 700], np.split(flat, np.cumsum(counts)[:-1])):
            assert ids.tolist() == ask(t), repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_chunk_is_looked_up_once_for_many_texts(name):
    asked = Counter()

    class Counting(_encode._Index):
        def __getitem__(self, key):
            asked[key] += 1
            return super().__getitem__(key)

    ask, encoder = library(name), ChunkEncoder(vocabulary_path(name), keeps_space(name))
    encoder.index = Counting()
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCéß", k=rng.randint(1, 12))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=100)) for _ in range(60)]
    flat, counts = encoder.encode(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [ask(t) for t in texts]
    assert max(asked.values()) == 1 and len(asked) <= 2 * len(words)


def test_words_of_latin_letters_go_to_the_bare_model():
    name, whole = "byte_bpe_50k.json", []

    class Watched(ChunkEncoder):
        def _library(self, texts, lib=None):
            if lib is None or lib is self.lib:
                whole.extend(texts)
            return super()._library(texts, *([] if lib is None else [lib]))

    rng, letters = random.Random(5), [chr(c) for c in range(0x250) if chr(c).isalpha()]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(3000)] + letters
    texts = [x.join(rng.choices(words, k=90)) for x in " \n" for _ in range(60)] + [" ".join(letters)]
    ask, encoder = library(name), Watched(vocabulary_path(name), keeps_space(name))
    for _ in range(2):
        flat, counts = encoder.encode(texts)
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [ask(t) for t in texts]
    assert sum(map(len, whole)) < 10 and len(encoder.index) > 2000


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_full_cache_keeps_the_chunks_met_again(name):
    learnt = Counter()

    class Watched(ChunkEncoder):
        def _learn(self, plain):
            learnt.update(list(self.index)[self.known:])
            super()._learn(plain)

    ask, encoder = library(name), Watched(vocabulary_path(name), keeps_space(name), cache_chunks=300)
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=9))
    common = [word() for _ in range(60)]
    for _ in range(20):
        texts = [" ".join(["a", *common, *(word() for _ in range(20)), "\t" + word()][:k]) for k in (0, 81, 81, 82)]
        flat, counts = encoder.encode(texts)
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [ask(t) for t in texts]
        assert len(encoder.index) <= 300 + 100
    assert all(learnt[x] == 1 for x in common)
    for _ in range(12):  # all are met again: the oldest half stays at most
        texts = [" ".join(word() for _ in range(100))]
        for _ in range(2):
            flat, counts = encoder.encode(texts)
            assert flat.tolist() == ask(texts[0])
            assert len(encoder.index) <= 300 + 100


def test_white_space_and_marks_are_found_as_by_patterns():
    import re

    rng = random.Random(9)
    rare = [chr(c) for c in range(0x3001) if _encode._RARE_SPACE.match(chr(c))]
    parts = [*"ab1_é中😀ß’,.", ",", ".", *" \n", " ", "\x00", "\u2010", "\u3001", "\xa1"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(3000)]
    texts += [a + c + b for c in rare for a in ("", "a", "é") for b in ("", "a", " ")]
    rng.shuffle(texts)
    for t, rare, run, zero in zip(texts, *map(list, _encode._marked(texts))):
        assert zero == ("\x00" in t)
        assert rare == bool(_encode._RARE_SPACE.search(t) or re.search("[ \n][ \n]|[ \n]\\Z", t)), repr(t)
        assert run == bool(re.search(r"[\W_][,.][ \n]", t)), repr(t)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_counts_and_cache(spark, odd, none, scratch):
    ask = library("word_bpe_49k.json")
    want = Counter((i, len((t or "").encode()), len(ask(t)), len(ask(t)) > 2048) for i, t, *_ in odd_rows())
    first = token_counts.count_tokens(odd, scratch).collect()
    assert Counter(tuple(r)[:4] for r in first) == want and not any(r.cached for r in first)
    stored = spark.read.parquet(scratch)
    n = stored.count()
    again = token_counts.count_tokens(odd, scratch).collect()
    assert Counter(tuple(r)[:4] for r in again) == want and all(r.cached for r in again)
    assert spark.read.parquet(scratch).count() == n == stored.select("content_digest").distinct().count()
    assert token_counts.count_tokens(none, scratch).count() == 0
    other = token_counts.count_tokens(odd, scratch, "byte_bpe_50k.json").collect()
    assert not any(r.cached for r in other)  # another tokenizer's counts are no hits


def test_files(spark, odd, none, scratch):
    ask = library("byte_bpe_50k.json")
    token_files.write_tokens(odd, scratch, row_group_bytes=64 << 10, page_bytes=4 << 10)
    got = {}
    for r in token_files.read_tokens(spark, scratch).collect():
        got.setdefault(r.doc_id, []).append(r.tokens)
    want = defaultdict(list)
    for i, t, *_ in odd_rows():
        want[i].append(ask(t) + [0])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert {r.doc_id for r in token_files.read_tokens(spark, scratch, 5, 6).collect()} == {5, 6}
    counts = token_files.read_counts(spark, scratch)
    assert "tokens:array" not in counts._jdf.queryExecution().executedPlan().toString()
    starts = sorted(r.start for r in token_files.starts(spark, scratch).collect())
    sizes = [r.n_tokens for r in token_files.starts(spark, scratch).orderBy("start").collect()]
    assert starts == [0, *np.cumsum(sizes)[:-1].tolist()]
    for f in spark.read.parquet(scratch).inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata
        for g in range(meta.num_row_groups):
            kinds = {meta.row_group(g).column(c).path_in_schema.split(".")[0]: meta.row_group(g).column(c)
                     for c in range(meta.num_columns)}
            assert "DELTA_BINARY_PACKED" in kinds["n_tokens"].encodings
            assert "RLE_DICTIONARY" in kinds["tokens"].encodings
            assert kinds["tokens"].has_column_index and kinds["tokens"].has_offset_index
    token_files.write_tokens(none, scratch + "-none")
    assert token_files.starts(spark, scratch + "-none").count() == 0


def test_file_query_is_in_id_order(spark, sf_docs):
    ask, at = library("byte_bpe_50k.json"), 0
    want = []
    for r in sf_docs.orderBy("doc_id").collect():
        ids = ask(r.text) + [0]
        want.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, token_files.op9_token_files(spark, SF).collect())) == want


def check_packing(rows, texts, capacity):
    ask, want = library("word_bpe_49k.json"), Counter()
    for i, t in texts:
        ids = ask(t) + [1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            want[i, k, a, len(ids[a:a + capacity]), crc(ids[a:a + capacity])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_packing(spark, odd, none):
    rows = packing.pack(odd, capacity=512, group_pieces=10).collect()
    bins, total = check_packing(rows, [(i, t) for i, t, *_ in odd_rows()], 512)
    assert bins <= total // 512 + 4
    assert packing.pack(none).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    bins, total = check_packing(packing.op3_best_fit_packing(spark, SF).collect(), docs, 4096)
    assert bins <= -(-total // 4096) + 1


def test_swaps_empty_bins_that_best_fit_leaves():
    lengths = np.array([6, 5, 5, 4, 4, 3, 3])  # best fit: 6+4, 5+5, 4+3+3
    assert len(packing.swap_search(packing.best_fit(lengths, 10), lengths, 10)) == 3
    lengths = np.array([7, 6, 3, 2, 2])  # 7+2 / 6+2 / 3 could be two bins of 10 by an exchange
    assert len(packing.swap_search([[0, 3], [1, 4], [2]], lengths, 10)) == 2
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = rng.integers(1, 60, rng.integers(1, 80))
        bins = packing.swap_search(packing.best_fit(lengths, 64), lengths, 64)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(lengths[b].sum() <= 64 for b in bins)
        assert len(bins) <= len(packing.best_fit(lengths, 64))
