"""Compression of vectors into codes of product codebooks, in exact whole numbers.

Components become integers, vectors are cut into equal parts, and every part position has
a codebook of integer entries. The codebooks are a bounded broadcast (entries times
dimensions). Arrow batches compute the distances of all their parts to all entries as
|x|^2 - 2 x.c + |c|^2, the middle term by 64-bit integer matrix products, and take the
first least one. Sums and counts of each entry are added up in the task, then by a grouped
shuffle that holds one row per part, entry and component and task; vectors never move.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors whose distances are computed together.
SLICE = 1024
INT = np.int64


def limit(dim: int) -> int:
    """Greatest scaled component: the squared distance of two vectors that keep to it is below 2**62."""
    return math.isqrt((1 << 60) // max(dim, 1))


def scaled_vectors(column: pa.Array, dim: int | None = None, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that are kept, and their scaled components, a row for each.

    Dropped are null vectors, those with null or non-finite components and, where ``dim`` is
    given, those of another length; without ``dim`` all of a batch must have one length.
    """
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    data = column.values.to_numpy(zero_copy_only=False)  # null components become NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(data))))
    ok = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False)
    if dim is not None:
        ok &= sizes == dim
    places = np.flatnonzero(ok)
    if not len(places):
        return places, np.zeros((0, dim or 0), INT)
    width = int(sizes[places[0]])
    with np.errstate(invalid="raise", over="ignore"):
        scaled = np.floor(data[offsets[places][:, None] + np.arange(width)] * scale)
    if scaled.size and np.abs(scaled).max() > limit(width):
        raise OverflowError(f"a component is beyond {limit(width) // scale}: squared distances would not fit into 64 bits")
    return places, scaled.astype(INT)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For vectors ``x`` (n, parts * d) the index of the nearest entry of every part's book (parts, entries, d), and the squared distance."""
    parts, entries, d = books.shape
    code, best = np.zeros((len(x), parts), INT), np.zeros((len(x), parts), INT)
    norms = (books * books).sum(axis=2)
    turned = np.ascontiguousarray(books.transpose(0, 2, 1))
    for at in range(0, len(x), SLICE):
        cut = np.ascontiguousarray(x[at : at + SLICE].reshape(-1, parts, d).transpose(1, 0, 2))
        far = (cut * cut).sum(axis=2)[:, :, None] - 2 * np.matmul(cut, turned) + norms[:, None, :]
        first = far.argmin(axis=2)  # of equal ones the first
        code[at : at + SLICE] = first.T
        best[at : at + SLICE] = np.take_along_axis(far, first[:, :, None], axis=2)[:, :, 0].T
    return code, best


def _sums(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, entries, d = books.shape
        total, count = np.zeros((parts * entries, d), INT), np.zeros(parts * entries, INT)
        for batch in batches:
            _, x = scaled_vectors(batch.column(0), dim)
            cell = (nearest(x, books)[0] + np.arange(parts) * entries).reshape(-1)
            np.add.at(total, cell, x.reshape(-1, d))
            count += np.bincount(cell, minlength=len(count))
        used = np.flatnonzero(count)
        place = np.tile(np.arange(d), len(used))
        arrays = [np.repeat(used, d), place, total[used].reshape(-1), np.repeat(count[used], d)]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["cell", "place", "total", "n"])

    return run


def _codes(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            places, x = scaled_vectors(batch.column("__vector"), dim)
            code, best = nearest(x, books)
            texts = code.astype(np.uint8).tobytes().hex()
            width = 2 * books.shape[0]
            rows = batch.drop_columns(["__vector"]).take(pa.array(places))
            more = [pa.array([texts[i : i + width] for i in range(0, len(texts), width)], pa.string()), pa.array(best.sum(axis=1))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*rows.schema.names, "code", "error"])

    return run


def first_books(vectors: DataFrame, id_col: str, vector_col: str, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """Books of the parts of the vectors with the least ids, in their order; None where no vector can be cut.

    The dimension is that of the least id whose vector can be cut into ``parts``. Rows that
    repeat an id each count, the smaller vector first; rows without an id come last.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col(id_col).alias("i"), v.alias("v")).filter(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & finite)
    order = [F.col("i").asc_nulls_last(), F.transform("v", lambda x: F.floor(x * SCALE)), F.size("v")]
    first = kept.orderBy(*order).limit(1).select(F.size("v").alias("dim")).first()
    if first is None:
        return None
    rows = kept.filter(F.size("v") == first["dim"]).orderBy(*order).limit(entries).select("v").collect()
    x = scaled_vectors(pa.array([r["v"] for r in rows], pa.large_list(pa.float64())), first["dim"])[1]
    return np.ascontiguousarray(x.reshape(len(rows), parts, -1).transpose(1, 0, 2))


def train_books(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, components) after ``rounds`` of assigning all vectors and averaging; None for no vectors."""
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits, so a book holds 256 entries at most")
    spark = vectors.sparkSession
    ship(spark)
    books = first_books(vectors, id_col, vector_col, parts, entries)
    for _ in range(rounds if books is not None else 0):
        n_parts, n_entries, d = books.shape
        shared = spark.sparkContext.broadcast(books)
        one = vectors.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_sums(shared, n_parts * d), "cell long, place long, total long, n long")
        rows = one.groupBy("cell", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()  # a row for each component of the books at most
        cell, place, total, n = (rows[c].to_numpy() for c in ("cell", "place", "total", "n"))
        books = books.copy()
        books.reshape(-1, d)[cell, place] = total // n  # rounds down; unused entries stay
        shared.unpersist()
    return books


def books_digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components in order of part, entry and place, as decimal numbers with commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist() if books is not None else [])).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray | None, vector_col: str = "embedding", keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """Rows (keep..., code, error) of the vectors that are kept: the entries' numbers as hex digits, and the summed squared distances."""
    names = [f"__k{i}" for i in range(len(keep))]  # whatever the other columns are called
    own = vectors.select(*[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)], F.col(vector_col).cast("array<double>").alias("__vector"))
    schema = ", ".join(f"{n} {t}" for n, t in own.drop("__vector").dtypes) + ", code string, error long"
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema).select(*[F.col(n).alias(k) for k, n in zip(keep, names, strict=True)], "code", "error")
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    out = own.mapInArrow(_codes(shared, books.shape[0] * books.shape[2]), schema)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keep, names, strict=True)], "code", "error")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Rows (id, code, error, label_error, codebooks_sha256), one for each vector that is kept.

    * Vectors that are null or hold null or non-finite components are dropped; so are those
      whose length is not that of the least id's vector which can be cut into ``parts``.
    * Fewer vectors than ``entries`` make smaller books. Repeated rows each count; vectors
      without an id are coded, but start no entry unless ids are fewer than entries.
    * Null labels form one group. A label may hold any share of the rows: sums are combined in
      the tasks, and the way back is a sort-merge join, which AQE splits.
    * An empty table gives an empty result; other columns are ignored.
    * A component beyond ``limit(dimension) / 256`` raises: distances would not fit into 64 bits.
    """
    books = train_books(vectors, id_col, vector_col, parts, entries, rounds)
    coded = materialize(encode(vectors, books, vector_col, (id_col, label_col)).withColumnsRenamed({id_col: "__id", label_col: "__label"}), "codes")
    sums = materialize(coded.groupBy("__label").agg(F.sum("error").alias("label_error")).withColumnRenamed("__label", "__of"), "label-errors")
    out = coded.join(sums.hint("merge"), F.col("__label").eqNullSafe(F.col("__of")))
    return out.select(F.col("__id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
