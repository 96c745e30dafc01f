"""Language-model scores from a subword lattice.

A document is the sequence of its words, each after a space, and an end. It is written by
drawing pieces of an existing public vocabulary one after another until the end is drawn.
Its probability is the sum over all of its segmentations into pieces: a forward recursion
over the lattice of each word, in logarithms, gives the word's marginal probability, and a
document's is the product. The pieces and the end together have probability one.

The vocabulary's order gives its pieces their scores. These weigh the segmentations of all
training words; the expected numbers of pieces, counted over the whole training corpus, are
added to what the vocabulary's own scores stand for, and the sums are the scores of the
next round (expectation maximisation with the vocabulary as prior).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ship
from .shingles import _BASE, _BYTE, HashIndex, U, _powers, mix64, slices, word_hashes

#: Words that every task holds (20 bytes each); rarer ones are scored once and joined.
MAX_HELD_WORDS = 1 << 20
#: Longest piece in bytes; bounds the work for one byte of a word.
MAX_PIECE = 16
#: Share of the subword probability that single bytes have, so that any word has a segmentation.
BYTE_SHARE = 1e-4
#: The bytes of words in lower case.
BYTES = [x for x in range(256) if not 65 <= x <= 90]
EM_ROUNDS = 2
#: Pieces that the vocabulary's own scores count for, beside those of the training words.
PRIOR = 10_000.0
#: Words whose lattices are computed side by side.
GROUP = 40_000
#: Longer words, in bytes, are computed one by one, this many positions at a time.
LONG, WINDOW = 256, 1 << 14


def public_pieces(model_path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a public vocabulary as bytes and their probabilities.

    The file orders its pieces by rank, and a piece of rank r gets a probability in
    proportion to 1 / (r + 10). The word-start mark is a leading space. All single bytes
    that words have are pieces; they come first.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_path)
    raw: dict[bytes, float] = {bytes([x]): 0.0 for x in BYTES}
    for i in range(p.get_piece_size()):
        if p.is_control(i) or p.is_unknown(i) or p.is_byte(i):
            continue
        b = p.id_to_piece(i).replace("▁", " ").encode().lower()
        if b.strip() and len(b) <= MAX_PIECE and b.count(b" ") == b.startswith(b" "):
            raw[b] = raw.get(b, 0.0) + 1.0 / (i + 10)
    return list(raw), smoothed(np.array(list(raw.values())))


def smoothed(weights: np.ndarray) -> np.ndarray:
    """Probabilities in proportion to the weights, with the bytes' own share."""
    p = (1 - BYTE_SHARE) * weights / max(weights.sum(), 1e-300)
    p[: len(BYTES)] += BYTE_SHARE / len(BYTES)
    return p


class Lattice:
    """Forward and backward recursions over the lattices of many words at a time."""

    def __init__(self, pieces: list[bytes], probs: np.ndarray):
        self.n = len(pieces)
        self.log = np.append(np.log(np.maximum(probs, 1e-300)), -np.inf)  # the last stands for no piece
        self.log[:-1][probs <= 0] = -np.inf
        keys = np.array([self._hash(np.frombuffer(b, np.uint8)[None, :])[0] for b in pieces], dtype=U)
        self.index = HashIndex(keys)

    @staticmethod
    def _prefix(b: np.ndarray) -> np.ndarray:
        h = np.zeros((b.shape[1] + 1, b.shape[0]), U)
        for j in range(b.shape[1]):
            h[j + 1] = h[j] * U(_BASE) + _BYTE[b[:, j]]
        return h

    def _hash(self, b: np.ndarray) -> np.ndarray:
        return mix64(self._prefix(b)[-1] + U(b.shape[1]))

    def edges(self, b: np.ndarray) -> list[list[np.ndarray]]:
        """edges[e][k]: piece of each word's bytes from e - 1 - k to e, ``n`` for none."""
        h, m = self._prefix(b), b.shape[1]
        power = [U(pow(_BASE, k, 1 << 64)) for k in range(MAX_PIECE + 1)]
        out: list[list[np.ndarray]] = [[]]
        for e in range(1, m + 1):
            row = []
            for k in range(1, min(e, MAX_PIECE) + 1):
                i = self.index.find(mix64(h[e] - h[e - k] * power[k] + U(k)))
                row.append(np.where(i < 0, self.n, i))
            out.append(row)
        return out

    def forward(self, edges: list[list[np.ndarray]]) -> np.ndarray:
        m, size = len(edges) - 1, len(edges[1][0])
        alpha = np.zeros((m + 1, size))
        for e in range(1, m + 1):
            alpha[e] = _logsum(np.stack([alpha[e - 1 - k] + self.log[i] for k, i in enumerate(edges[e])]))
        return alpha

    def _window(self, d: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The edges of a long word that end at positions a + 1 .. b: end, length and piece of each, by end."""
        low = max(0, a - MAX_PIECE)
        h = np.zeros(b - low + 1, U)
        # hashes of prefixes that begin at ``low``; those of pieces do not depend on where they begin
        up, down = _powers(b - low)
        np.cumsum(_BYTE[d[low:b]] * down[: b - low], out=h[1:])
        h *= np.concatenate((up[:1], up[: b - low]))
        ends, sizes, pieces = [], [], []
        e = np.arange(a + 1, b + 1)
        for k in range(1, MAX_PIECE + 1):
            at = e[e >= k] - low
            power = U(pow(_BASE, k, 1 << 64))
            i = self.index.find(mix64(h[at] - h[at - k] * power + U(k)))
            some = i >= 0
            ends.append(at[some] + low)
            sizes.append(np.full(int(some.sum()), k))
            pieces.append(i[some])
        end, size, piece = np.concatenate(ends), np.concatenate(sizes), np.concatenate(pieces)
        o = np.argsort(end, kind="stable")
        return end[o], size[o], piece[o]

    def long_forward(self, word: bytes) -> np.ndarray:
        """alpha of one word of any length; no more than a window's edges are held."""
        d = np.frombuffer(b" " + word, np.uint8)
        m = len(d)
        alpha = np.zeros(m + 1)
        for a in range(0, m, WINDOW):
            b = min(m, a + WINDOW)
            end, size, piece = self._window(d, a, b)
            score = self.log[piece]
            cut = np.searchsorted(end, np.arange(a + 1, b + 2)).tolist()
            size, score = size.tolist(), score.tolist()
            near = alpha[max(0, a - MAX_PIECE) : b + 1].tolist()
            base = max(0, a - MAX_PIECE)
            for e in range(a + 1, b + 1):
                x, y = cut[e - a - 1], cut[e - a]
                terms = [near[e - base - size[i]] + score[i] for i in range(x, y)]
                top = max(terms)
                near[e - base] = top + math.log(sum(math.exp(t - top) for t in terms))
            alpha[a + 1 : b + 1] = near[a + 1 - base :]
        return alpha

    def long_expect(self, word: bytes, weight: float, total: np.ndarray) -> None:
        d = np.frombuffer(b" " + word, np.uint8)
        m = len(d)
        alpha = self.long_forward(word)
        beta = np.full(m + 1, -np.inf)
        beta[m] = 0.0
        for a in reversed(range(0, m, WINDOW)):
            b = min(m, a + WINDOW)
            end, size, piece = self._window(d, a, b)
            score = self.log[piece]
            base = max(0, a - MAX_PIECE)
            near = beta[base : b + 1].tolist()
            for e, k, s in zip(end[::-1].tolist(), size[::-1].tolist(), score[::-1].tolist(), strict=True):
                x, y = near[e - k - base], near[e - base] + s
                near[e - k - base] = y if x == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
            beta[base : b + 1] = near
            np.add.at(total, piece, weight * np.exp(alpha[end - size] + score + beta[end] - alpha[m]))

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's marginal probability."""
        out = np.zeros(len(words))
        for at, b in by_length(words):
            out[at] = self.forward(self.edges(b))[-1] if b is not None else self.long_forward(words[at[0]])[-1]
        return out

    def expect(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations of the weighted words."""
        total = np.zeros(self.n + 1)
        for at, b in by_length(words):
            if b is None:
                self.long_expect(words[at[0]], float(weights[at[0]]), total)
                continue
            edges = self.edges(b)
            alpha = self.forward(edges)
            m = len(edges) - 1
            beta = np.full_like(alpha, -np.inf)
            beta[m] = 0.0
            w, ids, add = weights[at], [], []
            for e in range(m, 0, -1):
                # all edges that start at e are in beta[e] by now
                for k, i in enumerate(edges[e]):
                    s = self.log[i] + beta[e]
                    ids.append(i)
                    add.append(w * np.exp(alpha[e - 1 - k] + s - alpha[m]))
                    np.logaddexp(beta[e - 1 - k], s, out=beta[e - 1 - k])
            total += np.bincount(np.concatenate(ids), weights=np.concatenate(add), minlength=self.n + 1)
        return total[:-1]


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Words of one length at a time, as (their places, their bytes after a leading space); a long word alone, without bytes."""
    length = np.array([len(w) for w in words])
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for at in np.split(order, cuts):
        n = int(length[at[0]])
        if n > LONG:
            yield from ((at[i : i + 1], None) for i in range(len(at)))
            continue
        # longer words a few at a time, so that a group's lattice stays small
        step = max(1, 4_000_000 // (MAX_PIECE * (n + 1)))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            yield part, np.frombuffer(b"".join(b" " + words[j] for j in part), np.uint8).reshape(len(part), n + 1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the lower-case words of a task; ``bytes.lower`` and ``bytes.split`` know ASCII only."""
    counts: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    for batch in batches:
        for t in batch.column(0):
            counts.update((t.as_py() or "").encode().lower().split())
            if len(counts) > 1_000_000:
                yield out()
                counts = Counter()
    if counts:
        yield out()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[int]]]:
    words: list[bytes] = []
    counts: list[int] = []
    for batch in batches:
        words += batch.column(0).to_pylist()
        counts += batch.column(1).to_pylist()
        if len(words) >= GROUP or batch.nbytes > 1 << 24:
            yield words, counts
            words, counts = [], []
    if words:
        yield words, counts


def _expect_task(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(*given.value), 0.0
        for words, counts in _groups(batches):
            total = total + lattice.expect(words, np.array(counts, float))
        if isinstance(total, np.ndarray):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["piece", "x"])

    return run


def _word_task(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*given.value)
        for words, counts in _groups(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(counts, pa.int64()), pa.array(lattice.scores(words) / math.log(10)), pa.array(_hashes(words).view(np.int64))],
                names=["word", "c", "s", "h"],
            )

    return run


def _hashes(words: list[bytes]) -> np.ndarray:
    """The hash that ``word_hashes`` gives each word."""
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return word_hashes(np.frombuffer(b" ".join(words) + b" ", np.uint8), starts)[0]


def _document_task(held, n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, c, s = held.value
        base = np.log10((np.append(c, 0) + 0.5) / (n + 0.5 * (v + 1)))
        base[-1] = 0.0  # rare words are added later
        s = np.append(s, 0.0)
        for batch in batches:
            for i, j, d, docs in slices(batch.column(1)):
                h, b, e, at = word_hashes(d, docs)
                k = index.find(h)
                doc = np.repeat(np.arange(j - i), np.diff(at))
                sums = [np.bincount(doc, weights=x, minlength=j - i) for x in (k >= 0, base[k], s[k])]
                rare = np.flatnonzero(k < 0)
                lists = np.searchsorted(doc[rare], np.arange(j - i + 1)).astype(np.int32)
                buf = d.tobytes()
                texts = pa.array([buf[x:y].lower() for x, y in zip(b[rare].tolist(), e[rare].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).cast(pa.int64()),
                        pa.array(np.diff(at) + 1, pa.int64()),
                        pa.array(sums[0].astype(np.int64)),
                        pa.array(sums[1].astype(float)),
                        pa.array(sums[2].astype(float)),
                        pa.ListArray.from_arrays(pa.array(lists), texts),
                    ],
                    names=["__id", "n_tokens", "known", "base", "s", "rare"],
                )

    return run


def end_share(probs: np.ndarray, drawn: float, n_docs: int) -> tuple[np.ndarray, float]:
    """Probabilities of the pieces beside the end's, which is drawn once for each training document."""
    p_end = (n_docs + 1) / (drawn + PRIOR + n_docs + 1)
    return (1 - p_end) * probs, p_end


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1


def lattice_scores(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    Training documents are those whose crc32 of the id as text is not 1 modulo 5.

    * Null and empty texts have the end token only.
    * A null id counts as held out; rows that repeat are counted and scored each.
    * With no training documents all tokens are unknown, the model is the vocabulary alone with
      an end as likely as one piece of ``PRIOR``; an empty table gives an empty result.
    * Other columns are ignored. A text may be one word of any length: time is linear in it.
    * Word counts are combined in the tasks before the shuffle. The most frequent words (a
      fixed number) are held by every task; all others are scored once each and joined.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    is_held = F.coalesce(held_out("__id"), F.lit(True))
    train = texts.filter(~is_held)
    n_docs = train.count()
    counted = train.select("__text").mapInArrow(_count_words, "word binary, c long")
    words = materialize(counted.groupBy("word").agg(F.sum("c").alias("c")), "words")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = sums["n"] + n_docs, sums["v"] + (n_docs > 0)

    pieces, own = public_pieces(model_path)
    probs, p_end = end_share(own, 0.0, n_docs)
    for _ in range(EM_ROUNDS):
        given = sc.broadcast((pieces, probs))
        found = words.mapInArrow(_expect_task(given), "piece long, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect()  # a row for each piece at most
        given.unpersist()
        weights = PRIOR * own
        for r in found:
            weights[r["piece"]] += r["x"]
        probs, p_end = end_share(smoothed(weights), weights.sum() - PRIOR, n_docs)
    given = sc.broadcast((pieces, probs))
    word_scores = "word binary, c long, s double, h long"
    scored = materialize(words.mapInArrow(_word_task(given), word_scores), "word-scores")

    # the held words: from the greatest counts down, as many as the bound allows
    level = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("c")))).cast("long")
    least, listed = None, 0
    for r in sorted(scored.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # under 1100 rows
        if listed + r["count"] > MAX_HELD_WORDS:
            break
        least, listed = r["level"], listed + r["count"]
    least = least if least is not None else 1 << 62
    top = scored.filter(F.col("c") >= least).select("h", "c", "s").toArrow()
    held = sc.broadcast((HashIndex(top["h"].to_numpy().view(U)), top["c"].to_numpy(), top["s"].to_numpy()))
    del top

    parts = texts.mapInArrow(_document_task(held, n, v), "__id long, n_tokens long, known long, base double, s double, rare array<binary>")
    # a number of its own lets rows that repeat an id keep their own sums
    parts = materialize(parts.withColumn("__row", F.monotonically_increasing_id()), "parts")
    rare = parts.select("__row", F.explode("rare").alias("word")).groupBy("__row", "word").agg(F.count(F.lit(1)).alias("k"))
    rare = materialize(rare, "rare")
    seen = scored.filter(F.col("c") < least).select("word", "c", "s")
    unseen = materialize(rare.select("word").distinct().join(seen, "word", "left_anti").select("word", F.lit(0).cast("long").alias("c")), "unseen")
    unseen = unseen.mapInArrow(_word_task(given), word_scores).select("word", "c", "s")
    base = F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1)))
    tail = rare.join(seen.unionByName(unseen), "word").groupBy("__row")
    tail = tail.agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tk"), F.sum(F.col("k") * base).alias("tb"), F.sum(F.col("k") * F.col("s")).alias("ts"))
    out = parts.drop("rare").join(materialize(tail, "tails"), "__row", "left")
    end_base = math.log10((n_docs + 0.5) / (n + 0.5 * (v + 1)))
    end_score = math.log10(p_end)
    return out.select(
        F.col("__id").alias(id_col),
        is_held.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("tk", F.lit(0)) + int(n_docs > 0)).alias("n_known"),
        F.lit(sums["n"] + n_docs).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tb", F.lit(0.0)) + F.lit(end_base)).alias("base_score"),
        (F.col("s") + F.coalesce("ts", F.lit(0.0)) + F.lit(end_score)).alias("score"),
    )
