"""Token-id files: documents in id order, coded block by block, committed through a manifest, and read back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import id_coder
from .common import before_each, shared_dir, ship
from .storage import read_file, write_committed
from .tokens import encoder

#: Ids after which a file is closed.
FILE_IDS = 8 << 20
_MANIFEST = "part int, seq int, file string, n_docs long, n_ids long, bytes long, sha256 string"


def _file(ids: list[np.ndarray], doc_ids: list[np.ndarray], none: list[np.ndarray], sizes: list[np.ndarray]) -> bytes:
    """A table of the documents (id, whether it has one, number of ids), then the coded ids."""
    key, missing, n = np.concatenate(doc_ids), np.concatenate(none), np.concatenate(sizes)
    packed = zlib.compress(np.diff(key, prepend=0).astype("<i8").tobytes() + missing.astype("u1").tobytes() + n.astype("<u4").tobytes(), 6)
    return struct.pack("<QII", len(key), len(packed), zlib.crc32(packed)) + packed + id_coder.encode(np.concatenate(ids))


def _write(path: str, tokenizer: str, style: str, end_id: int, file_ids: int):
    """The files of a task's sorted documents; only one file's ids are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        enc = encoder(tokenizer, style)
        held: tuple[list, list, list, list] = ([], [], [], [])
        waiting = seq = 0

        def close() -> pa.RecordBatch:
            nonlocal held, waiting, seq
            data = _file(*held)
            name = f"ids-{part:06d}-{seq:06d}.bin"
            write_committed(path, name, str(attempt), data)
            row = {"part": part, "seq": seq, "file": name, "n_docs": sum(len(x) for x in held[3]), "n_ids": waiting, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
            held, waiting, seq = ([], [], [], []), 0, seq + 1
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            key = batch.column(0)
            missing = key.is_null().to_numpy(zero_copy_only=False)
            key = key.fill_null(0).to_numpy()
            for i, j, ids, offsets in enc.encode(batch.column(1), end_id):
                if ids.max() > 65535:
                    raise ValueError("the file format holds ids of at most 16 bits")
                for x, v in zip(held, (ids.astype(np.int32), key[i:j], missing[i:j], np.diff(offsets)), strict=True):
                    x.append(v)
                waiting += len(ids)
                if waiting >= file_ids:
                    yield close()
        if waiting:
            yield close()

    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str | None = None, style: str = "words", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> str:
    """Write the ids of all documents, each followed by ``end_id``, in ascending document id; return the folder.

    Documents are sorted over the cluster; every task writes its range, a file for each
    ``file_ids`` ids or so (a run of documents of 1 MB more at most, or one longer document).

    * Null and empty texts are the end id alone. Null ids come first. Rows that repeat an id
      are documents of their own, in the order of their texts' hashes; so an id, or none, may
      belong to any share of the rows, which then are several tasks' work.
    * Ids over 65,535 fail the job. An empty table gives a manifest without files; other
      columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    path = path or shared_dir(spark, "ids")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), "hash"]
    ranged = texts.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row")
    files = ranged.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_write(path, tokenizer, style, end_id, file_ids), _MANIFEST)
    files.write.parquet(f"{path}/_manifest")
    return path


def read_ids(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, ids]) of the documents in a folder's manifest.

    Files and blocks that differ from their checksums fail the job.
    """
    ship(spark)
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest")
    parts = before_each(manifest.groupBy("part").agg(F.sum("n_ids").alias("n")), "part", F.col("n"), "ahead")
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # the files of one task
    starts = manifest.join(parts, "part").select("file", "sha256", (F.col("ahead") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = read_file(path, row["file"])
                if hashlib.sha256(data).hexdigest() != row["sha256"]:
                    raise ValueError(f"{row['file']} differs from its manifest")
                n, size, crc = struct.unpack_from("<QII", data)
                packed = data[16 : 16 + size]
                if zlib.crc32(packed) != crc:
                    raise ValueError(f"{row['file']}: the document table differs from its checksum")
                table = zlib.decompress(packed)
                ids = np.cumsum(np.frombuffer(table, "<i8", n))
                none = np.frombuffer(table, "u1", n, 8 * n).astype(bool)
                lengths = np.frombuffer(table, "<u4", n, 9 * n).astype(np.int64)
                stream = id_coder.decode(data[16 + size :]).astype("<u4")
                ends = np.cumsum(lengths)
                parts = [stream[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                arrays = [pa.array(ids, pa.int64(), mask=none), pa.array(row["before"] + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    n_files = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if keep_ids else "")
    return starts.repartition(min(n_files, 4096), "file").mapInArrow(read, schema)
