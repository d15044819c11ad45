"""Exact token ids from the tokenizers library, asked once for each distinct chunk of text.

A text is cut where both public vocabularies split it anyway: before a single space or line
feed that follows and precedes other characters, and before a comma or full stop that follows
a letter or digit and precedes a space or line feed. The byte-level vocabulary keeps the white
space at the head of a chunk; the word vocabulary drops it (and lower-cases, so chunks of ASCII
texts are lower-cased before they are looked up). The ids of the chunks, joined, are the ids
of the whole text. Texts for which that is not certain are cut at fewer places, and texts that
hold one of the tokenizer's added tokens go to the library whole.
"""

from __future__ import annotations

import codecs
import itertools
import re
import sys
import types

import numpy as np

from vacancy_spark.llm._words import batches_of

# white space other than space and line feed; U+180E counts as such in old Unicode tables
_RARE_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -   "
                         "  　]")
_SPACE = re.compile("[\\s᠎]")
_RARE_BYTES = [chr(c).encode() for c in range(0x3001) if _RARE_SPACE.match(chr(c))]
_RARE_CODES = np.array([int.from_bytes(x.ljust(3, b"\0"), "big") for x in _RARE_BYTES])
_OTHER, _WORD, _GAP, _MARK, _RARE, _ZERO, _LEAD = range(7)  # kinds of bytes; the last: may begin rare white space
_KINDS = bytearray(256)
for _kind, _bytes in ((_WORD, [i for i in range(128) if chr(i).isalnum()]), (_GAP, b" \n"), (_MARK, b",."), (_ZERO, b"\0"),
                      (_RARE, [x[0] for x in _RARE_BYTES if len(x) == 1]),
                      (_LEAD, [x[0] for x in _RARE_BYTES if len(x) > 1])):
    for _i in _bytes:
        _KINDS[_i] = _kind
_KINDS = bytes(_KINDS)
_NO_WORD = re.compile(r"[\W_]")
_CUT = re.compile("(?<=[^\\s᠎])(?=[ \\n][^\\s᠎])")
_BARE = {"", "\x00", "\n"}
# letters alone, of scripts whose letters every version of Unicode agrees about
_LETTERS = re.compile("\x00?[A-Za-zªµºÀ-ÖØ-öø-\u024f]+")
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
# the character that stands for each byte in a byte-level vocabulary
_BYTE_CHARS = "".join(chr(b if b in _PRINTED else 0x100 + sum(x not in _PRINTED for x in range(b))) for b in range(256))
PLAIN, CUT, WHOLE = 0, 1, 2
SPLIT_CHARS = 8 << 20  # characters split at once
CACHE_CHUNKS = 400_000  # distinct chunks that one task keeps; then it forgets those met once
MODEL_WORDS = 30  # words that the library's model gets in one text
WORKER_CHUNKS = 600_000  # the same for an encoder that a Python worker keeps between tasks (some 120 MB)


class _Index(dict):
    """Chunk -> running number; a new chunk gets the next one."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class ChunkEncoder:
    """Token ids of whole texts, equal to ``encode(text, add_special_tokens=False)``.

    ``keeps_space``: white space belongs to the tokens (byte-level vocabulary) or is dropped.
    """

    def __init__(self, path: str, keeps_space: bool, cache_chunks: int = CACHE_CHUNKS):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.keeps_space, self.cache_chunks = keeps_space, cache_chunks
        self.mark_id = self.lib.encode("\n" if keeps_space else "|",
                                       add_special_tokens=False).ids[0]
        self.between = _separator(spec["model"]) if keeps_space else None
        if self.between:
            self.bare = Tokenizer(self.lib.model)  # the model alone, without any splitting
            self.between_id = self.bare.token_to_id(self.between)
            self.byte_chars = _BYTE_CHARS.replace(_BYTE_CHARS[ord("\n")], self.between)
        self._empty()

    def _empty(self) -> None:
        self.index = _Index()
        self.known = self.used = 0  # chunks whose ids are stored, ids stored
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.again = np.zeros(1 << 16, bool)  # chunks met in a later call than their first

    def _shrink(self) -> None:
        """Forget the chunks met in one call only, and all but the oldest of too many others."""
        keys, kept = list(self.index), np.flatnonzero(self.again[:self.known])[:self.cache_chunks // 2]
        lengths = self.lengths[kept]
        ids = self.ids[_ranges(self.starts[kept], lengths)]
        self._empty()
        self.index.update(zip(map(keys.__getitem__, kept.tolist()), range(len(kept))))
        self._add(np.arange(len(kept)), lengths, ids)

    def _add(self, at: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Store the ids of the chunks numbered ``at``, all that have none yet."""
        n, total = self.known + len(at), self.used + len(ids)
        while total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        self.ids[self.used:total] = ids
        self.starts[at] = self.used + np.cumsum(lengths) - lengths
        self.lengths[at] = lengths
        self.known, self.used = n, total

    def _library(self, texts: list[str], lib=None) -> list[list[int]]:
        lib = self.lib if lib is None else lib
        batch = getattr(lib, "encode_batch_fast", lib.encode_batch)
        return [e.ids for e in batch(texts, add_special_tokens=False)]

    def _chunks(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[list[str]]]:
        """Which way each text goes, the plain texts with a space between any two chunks, and the
        other texts' chunks. Keys of chunks: ``\\x00x`` stands for x, a line feed for itself, any
        other x for x after a space. Texts that go WHOLE to the library have none."""
        rare, run, zero = _marked(texts)
        way = np.where(rare, CUT, PLAIN)
        way[zero] = WHOLE
        for a in self.added:
            way[[i for i, t in enumerate(texts) if a in t]] = WHOLE
        plain, cut = [], []
        for text, how, runs in zip(texts, way.tolist(), run.tolist()):
            if how == CUT:
                cut.append(["\x00" + x for x in _CUT.split(text)])
            elif how == PLAIN:
                plain.append(self._spaced(text, runs))
        return way, plain, cut

    def _spaced(self, text: str, runs: bool) -> str:
        if not self.keeps_space and (text.isascii() or not ("Σ" in text or "İ" in text)):
            text = text.lower()
        if not runs:
            text = (text.replace(", ", " \x00, ").replace(". ", " \x00. ")
                    .replace(",\n", " \x00,\n").replace(".\n", " \x00.\n"))
        if not self.keeps_space:
            return text.replace("\n", " ").replace("\x00", "")
        text = text.replace("\n", " \n \x00")
        return text[1:] if text[0] == " " else "\x00" + text

    def _numbers(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of every chunk of the plain texts, and how many each text has; a chunk is
        looked up once for many texts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        rows, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in batches_of([len(t) for t in plain], SPLIT_CHARS):
            lists = pc.split_pattern(pa.array(plain[part], pa.large_string()), " ")
            found = lists.flatten().dictionary_encode()
            words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
            number = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            self.again[number[number < self.known]] = True
            rows.append(number[found.indices.to_numpy()])
            counts.append(np.diff(lists.offsets.to_numpy()))
        return np.concatenate(rows), np.concatenate(counts)

    def _learn(self, plain: int) -> None:
        """Ask the library for every chunk seen since the last call, many in one text.

        Chunks of numbers below ``plain`` hold no white space but a lone line feed. Those of letters
        alone are one piece to the library's pre-tokenizer, so its model is asked for them
        directly. Chunks without white space inside are joined by a mark that the library always
        makes one token of its own: a line feed (byte-level) or a lone bar (words).
        """
        new = list(itertools.islice(self.index, self.known, None))
        plain = max(0, plain - self.known)
        more = _LETTERS.fullmatch if self.between else lambda x: False
        words = [i for i, x in enumerate(new[:plain]) if x.isascii() and x.isalpha() or more(x)]
        rest = np.ones(len(new), bool)
        rest[words] = False
        body = {i: x[1:] if x[:1] == "\x00" else " " + x if x and x != "\n" else x
                for i, x in ((i, new[i]) for i in np.flatnonzero(rest).tolist())}
        alone = [i for i in body if (new[i] in _BARE if i < plain else
                                     _SPACE.search(new[i]) or not new[i].strip("\x00"))
                 or not self.keeps_space and "|" in new[i]]
        rest = set(alone)
        together = [i for i in body if i not in rest]
        flats, lengths = [], [np.zeros(0, np.int64)]
        mark = "\n" if self.keeps_space else " | "
        self._joined([body[i] for i in together], 100, mark.join, self.lib, self.mark_id, lengths, flats)
        self._store(self._library([body[i] for i in alone]), lengths, flats)
        if self.between:
            some = [x[1:] if x[0] == "\x00" else " " + x for x in map(new.__getitem__, words)]
            self._joined(some, MODEL_WORDS, self._in_bytes, self.bare, self.between_id, lengths, flats)
        else:
            ask = self.lib.model.tokenize
            for a in range(0, len(words), 10_000):
                some = [new[i] for i in words[a:a + 10_000]]
                some = ["Ġ" + x for x in some] if self.keeps_space else [x.lower() for x in some]
                self._store([[t.id for t in ask(x)] for x in some], lengths, flats)
        ids = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
        self._add(self.known + np.array(together + alone + words, np.int64), np.concatenate(lengths), ids)

    def _in_bytes(self, words: list[str]) -> str:
        """Words in the characters of the byte-level vocabulary, joined by the separator."""
        return codecs.charmap_decode("\n".join(words).encode(), "strict", self.byte_chars)[0]

    def _joined(self, pieces: list[str], size: int, join, lib, mark_id: int, lengths: list, flats: list) -> None:
        """Store the ids of ``pieces``, of which ``lib`` gets ``size`` in one text, with a mark between any two."""
        for a in range(0, len(pieces), 1000 * size):
            some = [pieces[b:b + size] for b in range(a, min(a + 1000 * size, len(pieces)), size)]
            for g, ids in zip(some, self._library([join(g) for g in some], lib)):
                ids = np.array(ids, np.uint32)
                at = np.flatnonzero(ids == mark_id)
                if len(at) == len(g) - 1:
                    lengths.append(np.diff(at, prepend=-1, append=len(ids)) - 1)
                    flats.append(ids[ids != mark_id])
                else:  # never seen; one by one is always right
                    self._store(self._library(g), lengths, flats)

    @staticmethod
    def _store(lists: list[list[int]], lengths: list, flats: list) -> None:
        lengths.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        flats.append(np.fromiter(itertools.chain.from_iterable(lists), np.uint32))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` one after the other, and the number of ids of each (null: 0)."""
        if len(self.index) > self.cache_chunks:
            self._shrink()
        some = [i for i, t in enumerate(texts) if t]
        way, plain, cut = self._chunks([texts[i] for i in some])
        rows, n = self._numbers(plain)
        known = len(self.index)
        more = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(cut)), np.int64)
        self.again[more[more < self.known]] = True
        self._learn(known)
        per_text = np.zeros(len(texts), np.int64)
        some = np.array(some, np.int64)
        per_text[some[way == PLAIN]] = n
        if cut:
            per_text[some[way == CUT]] = np.fromiter(map(len, cut), np.int64, len(cut))
            own = np.zeros(len(texts), bool)
            own[some[way == CUT]] = True
            own = np.repeat(own, per_text)
            both = np.empty(len(own), np.int64)
            both[own], both[~own] = more, rows
            rows = both
        whole = some[way == WHOLE].tolist()
        lengths = self.lengths[rows]
        flat = self.ids[_ranges(self.starts[rows], lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        last = np.cumsum(per_text)
        counts = sums[last] - sums[last - per_text]
        if whole:
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for i, ids in zip(whole, self._library([texts[i] for i in whole])):
                parts[i] = np.array(ids, np.uint32)
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            flat = np.concatenate(parts)
        return flat, counts


def _separator(model: dict) -> str | None:
    """A token that stands for a byte of no UTF-8 text and that the byte-level model never merges; so the ids
    of words that it separates are those of each word. None if there is none or the model does more than merge."""
    if model.get("type") != "BPE" or any(model.get(k) for k in (
            "dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    merged = set(itertools.chain.from_iterable(itertools.chain.from_iterable(model["merges"])))
    return next((c for c in _BYTE_CHARS[0xF5:] if c in model["vocab"] and c not in merged), None)


def _marked(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text (none empty) whether it holds white space other than single spaces and line
    feeds inside it; a comma or full stop, before one of these, that follows neither letter nor digit;
    a zero byte."""
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    joined = b"".join([b" " * 4, *raw, b" " * 4])  # no place lacks neighbours
    data = np.frombuffer(joined, np.uint8)
    kind = np.frombuffer(joined.translate(_KINDS), np.uint8)
    bounds += 4
    body = slice(4, len(data) - 4)
    rare, run, zero = (np.zeros(len(texts), bool) for _ in range(3))

    def owner(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, at, "right") - 1

    gap = kind == _GAP
    rare[gap[bounds[1:] - 1]] = True  # so a gap at the next text's head makes no difference
    rare[owner(np.flatnonzero(gap[body] & gap[5:len(data) - 3]) + 4)] = True
    odd = np.flatnonzero(kind[body] >= _RARE) + 4
    rare[owner(odd[kind[odd] == _RARE])] = True
    zero[owner(odd[kind[odd] == _ZERO])] = True
    at = odd[kind[odd] == _LEAD]
    if len(at):
        code = (data[at].astype(np.int64) << 16) | (data[at + 1].astype(np.int64) << 8)
        code |= np.where(data[at] < 0xE0, 0, data[at + 2])
        rare[owner(at[np.isin(code, _RARE_CODES)])] = True
    at = np.flatnonzero((kind[body] == _MARK) & gap[5:len(data) - 3]) + 4
    own = owner(at)
    # within its text: a mark that its text ends with is followed by no gap of its own
    keep = (at > bounds[own]) & (at + 1 < bounds[own + 1]) & (kind[at - 1] != _WORD)
    at, own = at[keep], own[keep]
    run[own[data[at - 1] < 0x80]] = True
    far = data[at - 1] >= 0x80
    at, own = at[far], own[far]
    if len(at):  # the character before, of up to four bytes
        kinds, which = np.unique(data[at[:, None] + np.arange(-4, 0)], axis=0, return_inverse=True)
        no_word = [bool(_NO_WORD.match(x.tobytes().decode(errors="ignore")[-1])) for x in kinds]
        run[own[np.array(no_word)[which.ravel()]]] = True
    return rare, run, zero


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lengths[0] of them), then starts[1], ..."""
    some = lengths > 0
    starts, lengths = starts[some], lengths[some]
    if not len(starts):
        return np.zeros(0, np.int64)
    step = np.ones(int(lengths.sum()), np.int64)
    step[0] = starts[0]
    step[np.cumsum(lengths)[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(step)


def worker_encoder(path: str, keeps_space: bool) -> ChunkEncoder:
    """The encoder of this Python worker, kept over its tasks (the cache only saves work)."""
    kept = sys.modules.setdefault("_kept_chunk_encoders", types.ModuleType("_kept"))
    if path not in vars(kept):
        setattr(kept, path, ChunkEncoder(path, keeps_space, WORKER_CHUNKS))
    return vars(kept)[path]


def keeps_space(name: str) -> bool:
    """Whether white space belongs to the tokens of the public vocabulary ``name``."""
    return name.startswith("byte_")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
