"""Benchmark decontamination: word windows of test items, looked up in all documents.

The items' normalised texts are broadcast in blocks of bounded size. A worker makes a hash
set of their windows and slides over the words of whole documents with numpy; every hash
that is found is verified word by word against the item's own bytes. Words inside any
verified window are hit. Benchmarks within one block take one pass over the documents,
larger ones a pass for each block; the hits of several passes are merged by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, materialize, ship, with_rows, without_rows
from .shingles import _BYTE, _LOWER, HashIndex, U, _powers, mix64, slices

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Bytes of item texts in a broadcast; its windows take at most some 60 MB of a worker.
BLOCK_BYTES = 8 << 20
#: Words of an item that stay together; longer items are cut into pieces that share all but one word of a window.
PIECE_WORDS = 1 << 16
#: Window pairs compared together.
COMPARED = 1 << 15

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

RUN = "array<struct<word_from:bigint,word_to:bigint,byte_from:bigint,byte_to:bigint>>"


class Words:
    """The words in the bytes ``d`` of texts that start at ``texts`` (and end at the last of these)."""

    def __init__(self, d: np.ndarray, texts: np.ndarray):
        word = _WORD[d]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = texts[(texts > 0) & (texts < len(d))]
        first[inner], last[inner - 1] = word[inner], word[inner - 1]
        self.d, self.begin, self.end = d, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.begin, texts)
        self.text = np.repeat(np.arange(len(texts) - 1), np.diff(self.at))
        up, down = _powers(len(d))
        sums = np.zeros(len(d) + 1, dtype=U)
        np.cumsum(_BYTE[d] * up[: len(d)], out=sums[1:])
        own = mix64((sums[self.end] - sums[self.begin]) * down[self.begin] + (self.end - self.begin).astype(U))
        self.sums, self.down = np.zeros(len(own) + 1, dtype=U), down
        np.cumsum(own * up[: len(own)], out=self.sums[1:])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the windows of ``size`` words that lie within one text."""
        m = max(0, len(self.begin) - size + 1)
        i = np.flatnonzero(self.text[:m] == self.text[size - 1 :]) if m else np.zeros(0, np.int64)
        return i, mix64((self.sums[i + size] - self.sums[i]) * self.down[i] + U(size))


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray, size: int) -> np.ndarray:
    """Whether the windows from words ``i`` of ``a`` and ``j`` of ``b`` have the same words, capitals A-Z aside."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), COMPARED):
        x, y = (w[at : at + COMPARED, None] + np.arange(size) for w in (i, j))
        n = a.end[x] - a.begin[x]
        alike = (n == b.end[y] - b.begin[y]).all(axis=1)
        x, y, n = x[alike], y[alike], n[alike]
        lengths, before = n.reshape(-1), np.cumsum(n.reshape(-1)) - n.reshape(-1)
        along = np.arange(lengths.sum())
        p, q = (np.repeat(w.reshape(-1) - before, lengths) + along for w in (a.begin[x], b.begin[y]))
        differ = np.concatenate(([0], np.cumsum(_LOWER[a.d[p]] != _LOWER[b.d[q]])))
        ends = np.concatenate(([0], np.cumsum(n.sum(axis=1))))
        out[at + np.flatnonzero(alike)] = differ[ends[1:]] == differ[ends[:-1]]
    return out


class WindowSet:
    """The windows of a block's pieces; equal ones are one, with all its items."""

    def __init__(self, pieces: list[bytes], items: np.ndarray, size: int = WINDOW):
        self.words = Words(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64))
        counts = np.diff(self.words.at)
        self.by_size = {}
        for n in sorted({min(size, c) for c in counts.tolist() if c}):
            i, h = self.words.windows(n)
            own = counts[self.words.text[i]]
            i, h = (x[(own >= size) if n == size else (own == n)] for x in (i, h))
            self.by_size[n] = self._table(i, h, items, n)

    def _table(self, i: np.ndarray, h: np.ndarray, items: np.ndarray, size: int):
        """Distinct windows: an index of their hashes, first words, the next one of an equal hash, and their items."""
        of, firsts, following = np.full(len(i), -1), [], []
        open_, last = np.arange(len(i)), {}
        while len(open_):  # a second time only where different windows have one hash
            keys, first, back = np.unique(h[open_], return_index=True, return_inverse=True)
            if not firsts:
                index = HashIndex(keys)
            base, lead = len(firsts), open_[first]
            alike = same_words(self.words, i[open_], self.words, i[lead][back], size)
            of[open_[alike]] = base + back[alike]
            firsts += i[lead].tolist()
            following += [-1] * len(lead)
            if base or not alike.all():
                for k, key in enumerate(keys.tolist()):
                    if key in last:
                        following[last[key]] = base + k
                    last[key] = base + k
            open_ = open_[~alike]
        pairs = np.unique(np.stack([of, items[self.words.text[i]]]), axis=1)
        return index, np.array(firsts), np.array(following), np.searchsorted(pairs[0], np.arange(len(firsts) + 1)), pairs[1]

    def find(self, texts: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Verified hits: first and last word of each, and the distinct pairs (text, item)."""
        begins, ends, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((2, 0), np.int64)]
        for n, (index, firsts, following, starts, items) in self.by_size.items():
            i, h = texts.windows(n)
            k = index.find(h)
            i, k = i[k >= 0], k[k >= 0]
            while len(i):
                alike = same_words(texts, i, self.words, firsts[k], n)
                begins.append(i[alike])
                ends.append(i[alike] + n)
                which = np.unique(np.stack([texts.text[i[alike]], k[alike]]), axis=1)
                many = starts[which[1] + 1] - starts[which[1]]
                place = np.repeat(starts[which[1]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                found.append(np.stack([np.repeat(which[0], many), items[place]]))
                i, k = i[~alike], following[k[~alike]]
                i, k = i[k >= 0], k[k >= 0]
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return np.concatenate(begins), np.concatenate(ends), pairs[0], pairs[1]


def _scan(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, numbers, names = shared.value
        windows = WindowSet(pieces, numbers, size)
        run_type = pa.struct([(k, pa.int64()) for k in ("word_from", "word_to", "byte_from", "byte_to")])
        for batch in batches:
            keep = batch.drop_columns(["__text"])
            for a, b, d, texts in slices(batch.column("__text")):
                words = Words(d, texts)
                begin, end, doc, item = windows.find(words)
                cover = np.zeros(len(words.begin) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, end, -1)
                hit = np.cumsum(cover[:-1]) > 0
                # maximal runs of hit words of one text
                edge = np.ones(len(hit) + 1, bool)
                edge[1:-1] = (hit[1:] != hit[:-1]) | (words.text[1:] != words.text[:-1])
                edges = np.flatnonzero(edge)
                x, y = edges[:-1][hit[edges[:-1]]], edges[1:][hit[edges[:-1]]]
                of = words.text[x]
                fields = [x - words.at[of], y - words.at[of], words.begin[x] - texts[of], words.end[y - 1] - texts[of]]
                n = b - a
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(f) for f in fields], fields=list(run_type)))
                items = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), names.take(pa.array(item)))
                yield pa.RecordBatch.from_arrays([*keep.slice(a, n).columns, pa.array(np.diff(words.at)), runs, items], names=[*keep.schema.names, "n_words", "runs", "items"])

    return run


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[bytes], np.ndarray, pa.Array]]:
    """Pieces of the items' words with their items' numbers, and the items' names, in blocks of at most ``block_bytes`` or one piece.

    The driver holds one block and one task's items at a time.
    """
    of = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("t")).filter("t IS NOT NULL")
    pieces, numbers, names, held = [], [], {}, 0
    other = bytes(np.where(_WORD, np.arange(256), 32).astype(np.uint8))
    for row in of.toLocalIterator():
        words = bytes(row["t"]).translate(other).split()
        for s in range(0, max(1, len(words) - size + 1) if words else 0, PIECE_WORDS):
            piece = b" ".join(words[s : s + PIECE_WORDS + size - 1]).lower() + b" "
            if pieces and held + len(piece) > block_bytes:
                yield pieces, np.array(numbers), pa.array(list(names), pa.string())
                pieces, numbers, names, held = [], [], {}, 0
            pieces.append(piece)
            numbers.append(names.setdefault(row["i"], len(names)))
            held += len(piece)
    if pieces:
        yield pieces, np.array(numbers), pa.array(list(names), pa.string())


def _merged(runs: Column) -> Column:
    """Runs of several passes, sorted, with those that overlap or touch as one."""
    start = F.array().cast(RUN)

    def step(done: Column, r: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["word_from"].alias("word_from"), F.greatest(last["word_to"], r["word_to"]).alias("word_to"), last["byte_from"].alias("byte_from"), F.greatest(last["byte_to"], r["byte_to"]).alias("byte_to"))
        return F.when((F.size(done) > 0) & (r["word_from"] <= last["word_to"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)).cast(RUN)).otherwise(F.concat(done, F.array(r)).cast(RUN))

    return F.aggregate(F.array_sort(runs), start, step)


def find_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (keep..., n_words, runs, items) for every document.

    ``runs`` are the maximal runs of hit words, as word and as UTF-8 byte positions in the
    text, ends exclusive; ``items`` the distinct names of the items with windows in it.

    * Null texts, and items without words, have no words. Items of fewer words than ``size`` are one window.
    * Rows of one item_id are one item; those without an id are one item whose name is ''.
    * Repeated documents are looked at each. Empty tables give no rows, or rows without hits.
      Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks = item_blocks(benchmark, item_col, item_text_col, size, block_bytes)
    block, following = next(blocks, ([], np.zeros(0, np.int64), pa.array([], pa.string()))), next(blocks, None)

    def one(rows: DataFrame, columns: list[str], block) -> DataFrame:
        names = [f"__k{i}" for i in range(len(columns))]
        own = rows.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.col(text_col).cast("string").alias("__text"))
        schema = ", ".join([f"{n} {t}" for n, t in own.drop("__text").dtypes] + ["n_words long", f"runs {RUN}", "items array<string>"])
        out = own.mapInArrow(_scan(spark.sparkContext.broadcast(block), size), schema)
        return out.select(*[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)], "n_words", "runs", "items")

    if following is None:
        return one(docs, list(keep), block)
    rows = docs if ROW in docs.columns else with_rows(docs)
    columns = list(dict.fromkeys([ROW, *keep]))
    first = materialize(one(rows, columns, block), "hits")
    hits = [first.select(ROW, "runs", "items").filter("size(runs) > 0")]
    while following is not None:  # a further pass for each further block; only documents with hits are written
        hits.append(materialize(one(rows, [ROW], following).drop("n_words").filter("size(runs) > 0"), "hits"))
        following = next(blocks, None)
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    every = every.groupBy(ROW).agg(F.flatten(F.collect_list("runs")).alias("__runs"), F.flatten(F.collect_list("items")).alias("__items"))
    every = materialize(every.select(F.col(ROW).alias("__hit"), _merged(F.col("__runs")).alias("__runs"), F.array_distinct("__items").alias("__items")), "merged")
    both = first.join(every.hint("merge"), F.col(ROW) == F.col("__hit"), "left")
    return both.select(*[c for c in keep], "n_words", F.coalesce("__runs", "runs").alias("runs"), F.coalesce("__items", "items").alias("items"))


def n_hit() -> Column:
    return F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["word_to"] - r["word_from"])


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, n_words, n_hit, n_items, items_sha256, contaminated) of ``find_passages``."""
    digest = F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "UTF-8"), 256)
    return found.select(id_col, "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit() > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", max_share: float = 0.0, **options) -> DataFrame:
    """``docs`` without benchmark passages: ``remove`` is ``documents`` or ``spans``.

    Documents go where more than ``max_share`` of their words are hit. Spans go from the
    first to the last byte of every run of hit words; what stands around them stays, and
    texts without hits, null ones too, are unchanged.
    """
    rows = with_rows(docs)
    found = find_passages(rows, benchmark, text_col, (ROW,), **options).filter("size(runs) > 0")
    if remove == "documents":
        return without_rows(rows, materialize(found.filter(n_hit() > F.lit(max_share) * F.col("n_words")).select(ROW), "contaminated"))
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    spans = materialize(found.select(F.col(ROW).alias("__of"), F.col("runs").alias("__runs")), "spans")
    data = F.encode(F.col(text_col), "UTF-8")

    def between(i: Column) -> Column:
        begin = F.coalesce(F.get("__runs", i - 1)["byte_to"], F.lit(0))
        end = F.coalesce(F.get("__runs", i)["byte_from"], F.octet_length(text_col))
        return F.decode(F.substring(data, (begin + 1).cast("int"), (end - begin).cast("int")), "UTF-8")

    cut = F.array_join(F.transform(F.sequence(F.lit(0), F.size("__runs")), between), "")
    both = rows.join(spans.hint("merge"), F.col(ROW) == F.col("__of"), "left")
    return both.withColumn(text_col, F.when(F.col("__of").isNull(), F.col(text_col)).otherwise(cut)).select(*docs.columns)
