"""Words of many texts at once, as numpy arrays: places, owners and 64-bit hashes.

A word is a run of bytes other than space and 0x09-0x0D; those are ASCII, so cutting UTF-8 at
them cuts between characters.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20  # A-Z
_BYTE = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all of them (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    base %= 1 << 64
    if len(_powers.get(base, ())) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x, dtype=np.uint64)
    return _powers[base][:n]


class Words:
    """Words of ``texts`` (bytes each; null texts are given as empty).

    ``data``: all texts, each followed by a line feed; ``bounds``: where each begins, and the
    end; ``start``, ``end``: each word's bytes in ``data``; ``doc``: its text; ``hash``. ``inside``:
    whether a byte belongs to a word. ``space``: which bytes separate words.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, hashes: bool = True,
                 space: np.ndarray = _SPACE):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        if lower:
            self.data = _LOWER[self.data]
        self.inside = inside = ~space[self.data]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.bounds)  # first word of each text, and the end
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        if hashes:
            term = _BYTE[self.data]
            term[~inside] = 0
            term *= powers(_BASE, len(self.data))
            self._total = np.cumsum(term, dtype=np.uint64)
            self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span within a word; equal bytes have equal hashes."""
        if not len(start):
            return np.zeros(0, np.uint64)
        own = self._total[end - 1] - np.where(start > 0, self._total[start - 1], np.uint64(0))
        own = own * powers(pow(_BASE, -1, 1 << 64), len(self.data))[start]
        return mixed(own + mixed((end - start).astype(np.uint64)))

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode()

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each word on, and whether they end within its text."""
        m = len(self.hash) - size + 1
        total = np.zeros(len(self.hash), np.uint64)
        if m > 0:
            for j in range(size):
                total[:m] = total[:m] * np.uint64(_BASE) + self.hash[j:j + m]
        whole = np.arange(len(self.hash)) + size <= self.first[1:][self.doc]
        return mixed(total), whole


def batches_of(sizes: np.ndarray, limit: int) -> list[slice]:
    """Consecutive slices whose sizes sum to ``limit`` at most (a larger item stands alone)."""
    out, a, total = [], 0, 0
    for i, s in enumerate(sizes):
        if i > a and total + s > limit:
            out.append(slice(a, i))
            a, total = i, 0
        total += int(s)
    return out + [slice(a, len(sizes))] if len(sizes) > a else out


def text_bytes(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 (null: empty)."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
