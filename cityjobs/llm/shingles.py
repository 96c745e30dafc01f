"""Word shingles of whole texts as sorted arrays of 64-bit hashes, computed a batch at a time with numpy.

Words are maximal runs of bytes other than ASCII white space, with A-Z lower-cased.
Two different shingles get the same hash with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_PLACE = _RNG.integers(1, 2**63, 8, dtype=U) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]  # upper and lower case letters hash alike
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text hashed at a time; a longer document is hashed alone.
SLICE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE) + 1
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, dtype=U)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def word_hashes(d: np.ndarray, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words in the bytes ``d``: hashes, begins and ends; and the index of each document's first word."""
    n = len(d)
    word = ~_SPACE[d]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = starts_of_docs[(starts_of_docs > 0) & (starts_of_docs < n)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    b, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(_BYTE[d] * up[:n], out=total[1:])
    h = mix64((total[e] - total[b]) * down[b] + (e - b).astype(U))
    return h, b, e, np.searchsorted(b, starts_of_docs)


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents (from, to) with their bytes and the offsets of each in these; nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i]).astype(np.int64)
        i = j


class HashIndex:
    """Places of 64-bit hashes in a table with open addressing, looked up a whole array at a time."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, U)
        self.vals = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys))
        slot = (keys >> self.shift).astype(np.int64)
        while len(todo):
            free = self.vals[slot] < 0
            s, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.vals[s], self.keys[s] = todo[won], keys[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The index of each hash among the keys, -1 where it is none."""
        slot = (h >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.vals[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.vals[slot] >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            v, hit = self.vals[slot], self.keys[slot] == h[open_]
            out[open_[hit & (v >= 0)]] = v[hit & (v >= 0)]
            go = ~hit & (v >= 0)
            open_, slot = open_[go], slot[go]
        return out


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, in order; nulls and texts without words give none.

    A text with fewer words than ``size`` has its whole sequence as one shingle.
    """
    for _, _, d, docs in slices(texts):
        h, _, _, at = word_hashes(d, docs)
        grams = np.zeros(0, dtype=U)
        if len(h) >= size:
            m = len(h) - size + 1
            grams = h[:m] * _PLACE[0]
            for k in range(1, size):
                grams += h[k : k + m] * _PLACE[k]
            grams = mix64(grams)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= size:
                s = np.sort(grams[a : b - size + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield mix64(np.array([(h[a:b] * _PLACE[: b - a]).sum(dtype=U) + U(b - a)], dtype=U))
            else:
                yield np.zeros(0, dtype=U)
