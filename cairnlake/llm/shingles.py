"""Word shingles of whole texts as numbers, a batch at a time.

Words are hashed from running sums over the batch's bytes, and five neighbouring word hashes
make a shingle's. All steps are numpy over the batch; no text is taken apart in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text and documents handled at once; a longer text is a batch by itself.
BATCH_BYTES, BATCH_DOCS = 2 << 20, 4096
#: A set element is the low bits of a shingle's hash; the document's place is kept above them.
BITS = 52

_MASK = np.uint64((1 << BITS) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, width: int = WIDTH):
        self.width = width
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        for up in range(65, 91):  # A-Z count as a-z
            self.values[up] = self.values[up + 32]
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.place = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) <= n:
            n = max(n + 1, BATCH_BYTES + 1)
            one = np.ones(1, np.uint64)
            self.power = np.concatenate([one, np.cumprod(np.full(n, _BASE, np.uint64))])
            self.inverse = np.concatenate([one, np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))])

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of each word."""
        solid = np.concatenate([[False], ~self.blank[data], [False]])
        begin, end = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begin[inner] |= solid[1:-1][inner]  # no word reaches over a text's end
        end[inner - 1] |= solid[1:-1][inner - 1]
        first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self._powers(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[data] * self.power[: len(data)])])
        word = mix((sums[last] - sums[first]) * self.inverse[first] + (last - first).astype(np.uint64))
        return word, np.searchsorted(offsets, first, side="right") - 1

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The distinct shingles of all texts: sorted, place of the text << BITS | shingle."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint64)
        word, doc = self._words(data, offsets)
        counts = np.bincount(doc, minlength=n)
        parts = []
        k = self.width
        if len(word) >= k:
            h = np.zeros(len(word) - k + 1, np.uint64)
            for i in range(k):
                h += word[i : len(word) - k + 1 + i] * self.place[i]
            whole = doc[: len(h)] == doc[k - 1 :]
            parts.append(mix(h[whole]) & _MASK | doc[: len(h)][whole].astype(np.uint64) << np.uint64(BITS))
        short = (counts > 0) & (counts < k)  # the whole sequence is their only shingle
        if short.any():
            at = np.cumsum(counts) - counts
            h = np.zeros(n, np.uint64)
            for i in range(k - 1):
                has = short & (counts > i)
                h[has] += word[at[has] + i] * self.place[i]
            h = mix(h + counts.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            parts.append((h & _MASK | np.arange(n, dtype=np.uint64) << np.uint64(BITS))[short])
        out = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a text column, bounded in bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(offsets, offsets[a] + BATCH_BYTES, side="right")) - 1
        b = min(max(b, a + 1), a + BATCH_DOCS, len(column))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def split_sets(keys: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets) from sorted keys of `docs` texts."""
    bounds = np.searchsorted(keys, np.arange(docs + 1, dtype=np.uint64) << np.uint64(BITS))
    bounds[docs] = len(keys)
    return keys & _MASK, bounds
