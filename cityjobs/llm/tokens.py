"""Token ids of whole texts from the public tokenizers, a slice of a batch at a time.

A text falls into units at places where the tokenizer's own pre-tokenizer always cuts, so
the ids of a text are its units' ids one after another. Units are found and looked up with
numpy; the tokenizers library encodes those that the worker does not hold, many by one
call, and texts are gathered from what it holds. What a worker holds is bounded by its
bytes, whatever the texts are like. Units are told apart by 64-bit hashes: one that is not
held passes for one of the two million held at most with probability 2**-43.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import _BYTE, _RNG, _SPACE, U, _powers, mix64, slices

#: Bytes of hashes and ids that a worker holds; it starts anew beyond.
MAX_HELD = 96 << 20
#: Longer units are encoded each time.
MAX_UNIT = 64
#: Units encoded by one call of the library.
CALL = 2048
#: Bytes of text whose units are looked up together.
RUN = 1 << 20

_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 44, 46, 58, 59, 63]] = True

_OPEN: dict[tuple[str, str], UnitEncoder] = {}


def _cuts(d: np.ndarray, cut: np.ndarray) -> None:
    """Between a letter and a stop, both ASCII; and before ASCII white space after what is no space in Unicode either.

    The last byte of a longer character is told by its lead: those of spaces are C2 and E1 to E3.
    """
    cut[1:-1] = _LETTER[d[:-1]] & _STOP[d[1:]]
    at = np.flatnonzero(_SPACE[d])
    at = at[at > 0]
    before = d[at - 1]
    ok = _GRAPHIC[before]
    high = np.flatnonzero(before >= 0x80)
    if len(high):
        p = at[high]
        two, three, four = d[p - 2], d[p - 3], d[p - 4]  # a lead found across the start of the slice is harmless: that is a cut
        ok[high] = ((two >= 0xC3) & (two < 0xE0)) | ((three >= 0xE4) & (three < 0xF0)) | (four >= 0xF0)
    cut[at[ok]] = True


class UnitTable:
    """Ids of units by hash: open addressing in arrays that double; whole arrays are looked up and added at a time."""

    def __init__(self):
        self.slots, self.count = np.full(1 << 14, -1, np.int32), 0
        self.keys, self.starts = np.zeros(1 << 12, U), np.zeros((1 << 12) + 1, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)

    def nbytes(self) -> int:
        return self.slots.nbytes + self.keys.nbytes + self.starts.nbytes + self.ids.nbytes

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def _place(self, todo: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = self._slot(self.keys[todo])
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]  # of several for a slot the last stays
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each unit, -1 where it is not held."""
        mask = len(self.slots) - 1
        slot = self._slot(h)
        out = self.slots[slot]
        at = np.flatnonzero((out >= 0) & (self.keys[out] != h))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & mask
            v = self.slots[slot]
            out[at] = v
            more = (v >= 0) & (self.keys[v] != h[at])
            at, slot = at[more], slot[more]
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New, distinct units with their ids one after another."""
        n, m = self.count, self.count + len(h)
        while m > len(self.keys):
            self.keys, self.starts = np.resize(self.keys, 2 * len(self.keys)), np.resize(self.starts, 2 * len(self.keys) + 1)
        first = int(self.starts[n])
        while first + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.keys[n:m], self.ids[first : first + len(ids)] = h, ids
        self.starts[n + 1 : m + 1] = first + np.cumsum(sizes)
        self.count = m
        if 2 * m > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int32)
            self._place(np.arange(m, dtype=np.int32))
        else:
            self._place(np.arange(n, m, dtype=np.int32))


#: Hash values of bytes where upper and lower case differ.
_CASED = _RNG.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
#: A mark that is one id of its own between units, for the tokenizer that drops white space.
_MARK = b"\x01"


class UnitEncoder:
    def __init__(self, path: str, style: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.bytes = style == "bytes"
        self.values = _CASED if self.bytes else _BYTE
        if self.bytes:  # a byte-level piece has a character for each byte
            vocab = self.tokenizer.get_vocab()
            self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
            self.lengths[list(vocab.values())] = [len(x) for x in vocab]
        else:
            (self.mark,) = self.tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids
        self.table = UnitTable()

    def _one(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)

    def _many(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after another, and the number of each, from one text that joins all that can be."""
        if self.bytes:
            # one that starts with white space and ends with a character that is surely none can stand next to another
            ok = [u[0] in b" \t\n\v\f\r" and (33 <= u[-1] < 127 or (u[-1] >= 0x80 and 0xC3 <= u[-2] < 0xE0)) for u in units]
        else:
            ok = [_MARK not in u for u in units]
        joined = [u for u, k in zip(units, ok, strict=True) if k]
        ids, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if joined and self.bytes:
            ids = self._one(b"".join(joined))
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(u) for u in joined])) + 1
            sizes = np.diff(ends, prepend=0)
        elif joined:
            ids = self._one(b" \x01 ".join(joined))
            marked = ids == self.mark
            at = np.flatnonzero(marked)
            sizes = np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1
            ids = ids[~marked]
        if len(joined) == len(units):
            return ids, sizes
        it = iter(np.split(ids, np.cumsum(sizes)))
        every = [next(it) if k else self._one(u) for u, k in zip(units, ok, strict=True)]
        return np.concatenate(every), np.array([len(x) for x in every], np.int64)

    def _run(self, d: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units of ``d`` one after another, and how many each has."""
        size = np.diff(bounds)
        if len(size) == 1 and size[0] > MAX_UNIT:
            ids = self._one(d.tobytes())
            return ids, np.array([len(ids)])
        if self.table.nbytes() > MAX_HELD:
            self.table = UnitTable()
        up, down = _powers(len(d))
        total = np.zeros(len(d) + 1, dtype=U)
        np.cumsum(self.values[d] * up[: len(d)], out=total[1:])
        h = mix64((total[bounds[1:]] - total[bounds[:-1]]) * down[bounds[:-1]] + size.astype(U))
        u = self.table.find(h)
        long = np.flatnonzero(size > MAX_UNIT)
        u[long] = 0
        new = np.flatnonzero(u < 0)
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            where = new[first]
            for at in range(0, len(fresh), CALL):
                units = [d[a:b].tobytes() for a, b in zip(bounds[where[at : at + CALL]].tolist(), bounds[where[at : at + CALL] + 1].tolist(), strict=True)]
                self.table.add(fresh[at : at + CALL], *self._many(units))
            u[new] = self.table.find(h[new])
        begin = self.table.starts[u]
        n = self.table.starts[u + 1] - begin
        n[long] = 0
        ends = np.cumsum(n)
        ids = self.table.ids[np.repeat(begin - (ends - n), n) + np.arange(ends[-1])]
        if len(long):
            apart, n[long] = self._many([d[bounds[k] : bounds[k + 1]].tobytes() for k in long.tolist()])
            ids = np.insert(ids, np.repeat(ends[long], n[long]), apart)
        return ids, n

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of texts (from, to) with their ids, each text's followed by ``end_id``, and the offsets of each in these."""
        for i, j, d, docs in slices(texts):
            cut = np.zeros(len(d) + 1, bool)
            if len(d):
                _cuts(d, cut)
            cut[docs] = True
            bounds = np.flatnonzero(cut)
            parts, sizes = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
            at = 0
            while at < len(bounds) - 1:
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + RUN, side="right")) - 1)
                ids, n = self._run(d[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
                parts.append(ids)
                sizes.append(n)
                at = to
            ends = np.cumsum(np.concatenate(sizes))[np.searchsorted(bounds, docs)]
            yield i, j, np.insert(np.concatenate(parts), ends[1:], end_id).astype("<u4", copy=False), ends + np.arange(j - i + 1)


def encoder(path: str, style: str) -> UnitEncoder:
    """The worker's encoder of a tokenizer file; ``style`` is ``bytes`` or ``words``."""
    if (path, style) not in _OPEN:
        _OPEN[path, style] = UnitEncoder(path, style)
    return _OPEN[path, style]
