"""Packing token sequences into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows. What is left of each is
put, longest first, into the open window where it leaves the least room; a segment tree
over the remaining capacities finds that window in log2(window) steps. Only lengths take
part; token ids are never moved to be packed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ship
from .tokens import encoder

#: Remainders that are packed together; more of them fill the last windows better, fewer spread better.
GROUP_PIECES = 16_384


class CapacityTree:
    """Open windows by remaining capacity; a node tells whether any window lies below it."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.some = bytearray(2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(self.size)]

    def push(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        i = capacity + self.size
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def pop_tightest(self, length: int) -> tuple[int, int] | None:
        """The window of the least capacity of at least ``length``, with that capacity."""
        i = length + self.size
        if not self.some[i]:
            while i > 1 and (i & 1 or not self.some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        capacity = i - self.size
        window = self.stacks[capacity].pop()
        if not self.stacks[capacity]:
            self.some[i] = 0
            i >>= 1
            while i and not (self.some[2 * i] or self.some[2 * i + 1]):
                self.some[i] = 0
                i >>= 1
        return window, capacity


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of every piece; pieces of equal length keep their order."""
    tree = CapacityTree(window)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        got = tree.pop_tightest(n)
        if got is None:
            got = (opened, window)
            opened += 1
        where[i], offset[i] = got[0], window - got[1]
        if got[1] > n:
            tree.push(got[1] - n, got[0])
    return where, offset


def _pieces(path: str, style: str, window: int, end_id: int, keep_ids: bool):
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, style)
        for batch in batches:
            for i, j, ids, offsets in enc.encode(batch.column(1), end_id):
                tokens = np.diff(offsets)
                n = -(-tokens // window)
                doc = np.repeat(np.arange(j - i), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(window, tokens[doc] - start)
                begin = offsets[doc] + start
                buf = memoryview(ids.tobytes())
                crc = [zlib.crc32(buf[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                arrays = [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[doc])]
                if keep_ids:  # the pieces one after another are the documents one after another
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def cut_pieces(docs: DataFrame, path: str, style: str = "bytes", window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids (``ids`` themselves if ``keep_ids``) of every document with its end id."""
    ship(docs.sparkSession)
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<bigint>" if keep_ids else "")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_pieces(path, style, window, end_id, keep_ids), schema)


def pack(pieces: DataFrame, window: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (id, start, length).

    * A full piece is a sequence of its own. The others are dealt out evenly into groups and
      packed in each; a group's last windows are the only ones that other groups could fill.
    * Ties (equal lengths) go by id and start; rows that repeat those are packed each.
    * Pieces without an id are packed like others. An empty table gives an empty result.
    """
    spark: SparkSession = pieces.sparkSession
    ship(spark)
    pieces = pieces.withColumn("__row", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pieces")
    rest = pieces.filter(F.col("length") < window).select("__row", "id", "start", "length")
    n_groups = max(1, -(-rest.count() // group_pieces))
    full_start = n_groups << 32

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "start", "__row"], na_position="first")
        where, offset = best_fit_decreasing(pdf["length"].to_numpy(), window)
        return pd.DataFrame({"__row": pdf["__row"], "sequence_id": (pdf["__group"].to_numpy().astype(np.int64) << 32) + where, "offset": offset})

    groups = rest.withColumn("__group", F.pmod(F.xxhash64("id", "start", "__row"), F.lit(n_groups)))
    placed = materialize(groups.groupBy("__group").applyInPandas(run, "__row long, sequence_id long, offset long"), "placed")
    out = pieces.join(placed, "__row", "left")
    return out.withColumn("sequence_id", F.coalesce("sequence_id", F.col("__row") + F.lit(full_start))).withColumn("offset", F.coalesce("offset", F.lit(0).cast("long"))).drop("__row")


def pack_documents(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", style: str = "bytes", keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack: rows (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Null and empty texts are documents of the end id alone. Every id is in one piece.
    """
    packed = pack(cut_pieces(docs, path, style, window, end_id, id_col, text_col, keep_ids), window)
    return packed.withColumnRenamed("id", id_col)
