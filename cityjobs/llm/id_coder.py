"""Adaptive context-mixing range coder for token ids, in blocks that are reset and checked each on its own.

A block's ids are dealt to lanes, equal runs that are coded side by side, so that a step is
array arithmetic over one id of every lane; the lanes share one model, which learns from
all of them. Everything is whole-number arithmetic, the same on every machine.

Model: the id last seen after the same two ids (order 2) and after the same one (order 1),
each with a confidence, and adaptive frequencies of all ids (order 0). How often the
order-2 prediction came true at its confidence, at the order-1 prediction's, and at its own
order-0 frequency are three inputs; a mixing network, trained on the way, makes of them the
probability that it comes true now. What it leaves goes to the order-1 prediction by its
own record, and the rest to all ids by order 0.

Coder: carry-less range coder with 64-bit state that moves 16 bits at a time. A block needs
nothing but its own bytes; it starts from the same state as any other.
"""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np

MAGIC = b"IDCM0002"
BLOCK_IDS = 1 << 22
LANES = 4096
#: Ids that a lane should have at least, as each costs some bytes.
LEAST_STEPS = 256
#: Entries of the order-2 table.
SLOTS_BITS = 20
_BLOCK = struct.Struct("<IIHI")
U = np.uint64
_16, _48 = U(16), U(48)
#: Bits of the choice among the predictions, and of order 0 below it.
FLAG_BITS, ORDER0_BITS = 14, 20
FLAG, ORDER0 = 1 << FLAG_BITS, 1 << ORDER0_BITS
_TOTAL = U(FLAG_BITS + ORDER0_BITS)
_LOW0 = U(ORDER0_BITS)
_LEAST = U(1 << 40)
#: Levels of confidence, and of order-0 frequency.
C, O = 8, 4
_N = C * C * 2 * O


@cache
def _curves() -> tuple[np.ndarray, np.ndarray]:
    """ln(p / (1 - p)) in 1/256, of p in 1/4096, and its inverse over -2047 .. 2047."""
    x = np.arange(4096)
    stretch = np.clip(np.rint(256 * np.log((x + 0.5) / (4095.5 - x))), -2047, 2047).astype(np.int64)
    squash = np.clip(np.rint(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 8, 4088).astype(np.int64)
    return stretch, squash


_J = np.arange(_N)
#: What a joint context stands for: confidences of orders 2 and 1, whether these agree, order-0 level.
J2, J1, JA, J0 = _J // (C * 2 * O), _J // (2 * O) % C, _J // O % 2, _J % O
_CONF_UP = np.array([[c >> 1, min(c + 1, C - 1)] for c in range(C)]).ravel()


class Model:
    """Predictions for the lanes of a block; ids are of 16 bits."""

    def __init__(self, alphabet: int):
        self.alphabet = alphabet
        # an entry is id | confidence << 16; 65535 without confidence where nothing was seen
        self.t1 = np.full(1 << 16, 65535, np.int64)
        self.t2 = np.full(1 << SLOTS_BITS, 65535, np.int64)
        self.seen = np.zeros(alphabet, np.int64)
        # the first frequencies suppose that lower ids are more usual
        self.prior = (1 << 20) // (np.arange(alphabet, dtype=np.int64) + 64) + 1
        self.tried = [np.full(n, 4, np.int64) for n in (C, 2 * C, 2 * O)]
        self.right = [(4 * (np.arange(n) % (n // k) + 1) // (n // k + 1)).astype(np.int64) for n, k in ((C, 1), (2 * C, 2), (2 * O, 2))]
        self.tried1, self.right1 = np.full(C * C, 8, np.int64), (np.arange(C * C) % C + 1).astype(np.int64)
        self.weights = np.full((2, 3), 30000, np.int64)
        self.steps = 0
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._order0()
        self._mix()

    def _order0(self) -> None:
        weight = self.seen * (64 * int(self.prior.sum()) // (1 << 18)) + self.prior
        freq = 1 + weight * (ORDER0 - self.alphabet) // int(weight.sum())
        freq[int(freq.argmax())] += ORDER0 - int(freq.sum())
        self.freq, self.cum = freq.astype(U), np.concatenate(([0], np.cumsum(freq)[:-1])).astype(U)
        level = np.zeros(1 << 16, np.int64)
        level[: self.alphabet] = (freq >= 64).astype(np.int64) + (freq >= 1024) + (freq >= 8192)
        self.level = level
        self.id_of = None

    def ids_of(self) -> np.ndarray:
        if self.id_of is None:
            self.id_of = np.repeat(np.arange(self.alphabet), self.freq.astype(np.int64))
        return self.id_of

    def _inputs(self) -> list[np.ndarray]:
        stretch, _ = _curves()
        p2, p1, p0 = (stretch[np.minimum(4095, (r * 4096) // t)] for r, t in zip(self.right, self.tried, strict=True))
        return [p2[J2], p1[JA * C + J1], p0[JA * O + J0]]

    def _mix(self) -> None:
        """Shares of the order-2 prediction, and of the order-1 prediction after it, for every joint context."""
        _, squash = _curves()
        self.x = self._inputs()
        dot = sum(self.weights[JA, i] * x for i, x in enumerate(self.x)) >> 16
        self.q = squash[np.clip(dot, -2047, 2047) + 2047]
        two = np.clip(self.q << (FLAG_BITS - 12), 16, FLAG - 64)
        share = np.minimum((self.right1 << 12) // self.tried1, 3840)[J2 * C + J1]
        one = np.where(JA == 1, 1, np.maximum(1, ((FLAG - two) * share) >> 12))
        self.two, self.one = two.astype(U), one.astype(U)

    def _learn(self) -> None:
        """Take what the last steps showed into account."""
        j, ids = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting = []
        kind, j = j & 3, j >> 2
        n = np.bincount(j, minlength=_N)
        hit = np.bincount(j[kind == 0], minlength=_N)
        one = np.bincount(j[kind == 1], minlength=_N)
        err = (hit << 12) - n * self.q
        total = max(1, int(n.sum()))
        for a in (0, 1):
            for i, x in enumerate(self.x):
                step = int((err * x)[JA == a].sum()) // total
                self.weights[a, i] = min(200000, max(-50000, int(self.weights[a, i]) + step // 16))
        fold = lambda v, at, m: np.bincount(at, weights=v, minlength=m).astype(np.int64)  # noqa: E731  whole numbers under 2**53
        for k, (at, m) in enumerate(((J2, C), (JA * C + J1, 2 * C), (JA * O + J0, 2 * O))):
            self.tried[k] += fold(n, at, m)
            self.right[k] += fold(hit, at, m)
            self._forget(self.tried[k], self.right[k])
        rest = (n - hit) * (JA == 0)
        self.tried1 += fold(rest, J2 * C + J1, C * C)
        self.right1 += fold(one, J2 * C + J1, C * C)
        self._forget(self.tried1, self.right1)
        self.seen += np.bincount(ids, minlength=self.alphabet)

    @staticmethod
    def _forget(tried: np.ndarray, right: np.ndarray) -> None:
        old = tried > 1 << 18
        tried[old] >>= 1
        right[old] >>= 1

    def predict(self, last: np.ndarray, before: np.ndarray) -> None:
        self.i1 = last
        self.i2 = ((last * 40503 + before * 2654435) >> 3) & ((1 << SLOTS_BITS) - 1)
        e1, e2 = self.t1.take(self.i1), self.t2.take(self.i2)
        self.p1, self.c1 = e1 & 65535, e1 >> 16
        self.p2, self.c2 = e2 & 65535, e2 >> 16
        agree = self.p1 == self.p2
        self.j = ((self.c2 * C + self.c1) * 2 + agree) * O + self.level.take(self.p2)
        self.f2, self.f1 = self.two.take(self.j), self.one.take(self.j)

    def place(self, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids in the coder's range."""
        self.hit2, self.hit1 = now == self.p2, now == self.p1
        self.missed = miss = ~(self.hit2 | self.hit1)
        not2, miss = (~self.hit2).astype(U), miss.astype(U)
        f12 = self.f2 + self.f1
        rest = U(FLAG) - f12
        start = ((self.f2 * not2 + self.f1 * miss) << _LOW0) + miss * rest * self.cum.take(now)
        hit = (self.f2 + not2 * (self.f1 - self.f2)) << _LOW0  # wraps back to f1
        return start, hit * (U(1) - miss) + miss * rest * self.freq.take(now)

    def update(self, now: np.ndarray) -> None:
        for t, i, p, c, hit in ((self.t1, self.i1, self.p1, self.c1, self.hit1), (self.t2, self.i2, self.p2, self.c2, self.hit2)):
            t[i] = (p + (now - p) * (c == 0)) | (_CONF_UP.take(2 * c + hit) << 16)  # of lanes with the same slot the last stays
        kind = np.where(self.hit2, 0, np.where(self.hit1, 1, 2))
        self.waiting.append((self.j << 2 | kind, now))
        self.steps += 1
        s = self.steps
        if s <= 8 or s % 8 == 0:
            self._learn()
            self._mix()
            if s <= 8 or (s <= 64 and s % 16 == 0) or s % 64 == 0:
                self._order0()


def _normal(low: np.ndarray, rng: np.ndarray, move) -> None:
    """Shift out 16 bits, by ``move(lanes)``, while a lane's upper ones are settled or its range is too small."""
    at = np.flatnonzero((((low ^ (low + rng)) >> _48) == 0) | (rng < _LEAST))
    while len(at):
        l, r = low[at], rng[at]
        r = np.where(((l ^ (l + r)) >> _48) == 0, r, (U(0) - l) & (_LEAST - U(1)))
        move(at, l)
        l, r = l << _16, r << _16
        low[at], rng[at] = l, r
        at = at[(((l ^ (l + r)) >> _48) == 0) | (r < _LEAST)]


def _lengths(n: int) -> tuple[int, int, int]:
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    return lanes, n // lanes, n % lanes


def encode_block(ids: np.ndarray) -> bytes:
    """One block of 16-bit ids: number, checksum, lanes, alphabet, the lanes' sizes, the lanes."""
    ids = np.ascontiguousarray(ids, dtype=np.int64)
    n = len(ids)
    lanes, base, more = _lengths(n)
    alphabet = int(ids.max()) + 1
    lengths = np.full(lanes, base) + (np.arange(lanes) < more)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    model = Model(alphabet)
    low, rng = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    out = np.zeros((lanes, 3 * (base + 1) + 4), np.uint16)
    size = np.zeros(lanes, np.int64)

    def move(at: np.ndarray, l: np.ndarray) -> None:
        out[at, size[at]] = (l >> _48).astype(np.uint16)
        size[at] += 1

    last = before = np.zeros(lanes, np.int64)
    for t in range(base + (more > 0)):
        m = lanes if t < base else more
        now = ids[starts[:m] + t]
        model.predict(last[:m], before[:m])
        begin, freq = model.place(now)
        l, r = low[:m], rng[:m]
        r >>= _TOTAL
        l += begin * r
        r *= freq
        _normal(l, r, move)
        model.update(now)
        before, last = last, now
    # the upper 32 bits of a number within the range; the decoder reads zeros beyond
    final = low + U(0xFFFFFFFF)
    for k in (48, 32):
        out[np.arange(lanes), size] = ((final >> U(k)) & U(0xFFFF)).astype(np.uint16)
        size += 1
    if out.shape[1] < int(size.max()):
        raise AssertionError("a lane outgrew its bound")
    body = b"".join(out[i, :k].astype("<u2").tobytes() for i, k in enumerate(size.tolist()))
    table = zlib.compress(size.astype("<u4").tobytes(), 6)
    head = _BLOCK.pack(n, zlib.crc32(ids.astype("<u4").tobytes()), lanes, alphabet)
    return head + struct.pack("<I", len(table)) + table + body


def decode_block(data: bytes) -> np.ndarray:
    """The ids of one block as int32; one that differs from its checksum raises ValueError."""
    n, crc, lanes, alphabet = _BLOCK.unpack_from(data)
    (k,) = struct.unpack_from("<I", data, _BLOCK.size)
    at = _BLOCK.size + 4
    try:
        size = np.frombuffer(zlib.decompress(data[at : at + k]), "<u4").astype(np.int64)
        body = np.frombuffer(data, "<u2", int(size.sum()), at + k)
    except (zlib.error, ValueError) as e:
        raise ValueError("a block differs from its checksum") from e
    words = np.zeros((lanes, int(size.max()) + 8), U)
    ends = np.cumsum(size)
    for i, (e, s) in enumerate(zip(ends.tolist(), size.tolist(), strict=True)):
        words[i, :s] = body[e - s : e]
    _, base, more = _lengths(n)
    model = Model(alphabet)
    low, rng = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    code = words[:, 0] << _48 | words[:, 1] << U(32) | words[:, 2] << _16 | words[:, 3]
    pos, most = np.full(lanes, 4, np.int64), words.shape[1] - 1

    def move(at: np.ndarray, l: np.ndarray) -> None:
        code[at] = code[at] << _16 | words[at, np.minimum(pos[at], most)]
        pos[at] += 1

    out = np.zeros((base + 1, lanes), np.int32)
    last = before = np.zeros(lanes, np.int64)
    for t in range(base + (more > 0)):
        m = lanes if t < base else more
        model.predict(last[:m], before[:m])
        l, r = low[:m], rng[:m]
        r >>= _TOTAL
        v = (code[:m] - l) // r
        flag = v >> _LOW0
        f12 = model.f2 + model.f1
        rest = U(FLAG) - f12
        inner = np.minimum(np.maximum(v, f12 << _LOW0) - (f12 << _LOW0), (rest << _LOW0) - U(1)) // rest
        now = np.where(flag < model.f2, model.p2, np.where(flag < f12, model.p1, model.ids_of().take(inner.astype(np.int64))))
        now = np.minimum(now, alphabet - 1)  # only in a block that is not as it was written
        begin, freq = model.place(now)
        l += begin * r
        r *= freq
        _normal(l, r, move)
        model.update(now)
        out[t, :m] = now
        before, last = last, now
    ids = np.concatenate([out[: base + (i < more), i] for i in range(lanes)])
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block differs from its checksum")
    return ids


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """A coded file: the sizes of its blocks, then the blocks."""
    n = len(ids)
    k = -(-n // block_ids)  # blocks of nearly equal size
    blocks = [encode_block(ids[n * i // k : n * (i + 1) // k]) for i in range(k)]
    return MAGIC + struct.pack("<I", len(blocks)) + np.array([len(b) for b in blocks], "<u8").tobytes() + b"".join(blocks)


def block_of(data: bytes, k: int) -> bytes:
    """The bytes of the k-th block of a coded file, all that ``decode_block`` needs."""
    if data[:8] != MAGIC:
        raise ValueError("not a coded id file")
    (n,) = struct.unpack_from("<I", data, 8)
    sizes = np.frombuffer(data, "<u8", n, 12).astype(np.int64)
    end = 12 + 8 * n + int(sizes[: k + 1].sum())
    return data[end - int(sizes[k]) : end]


def decode(data: bytes) -> np.ndarray:
    """The ids of a coded file as int32."""
    if data[:8] != MAGIC:
        raise ValueError("not a coded id file")
    (n,) = struct.unpack_from("<I", data, 8)
    return np.concatenate([np.zeros(0, np.int32), *(decode_block(block_of(data, k)) for k in range(n))])
