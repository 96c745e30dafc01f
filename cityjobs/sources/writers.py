"""Files with given names, written by tasks into a shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def write_files(files: DataFrame, folder: str) -> int:
    """Write ``content`` (text or bytes) of each row under ``name`` in ``folder``; returns the number of files.

    A file appears under its name only when it is whole: it is written under the name of the
    task's attempt and then moved, so a task that is repeated puts the same file there again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{path}/.{name}.{attempt}", compression=None) as f:
                    f.write(content.encode() if isinstance(content, str) else content)
                fs.move(f"{path}/.{name}.{attempt}", f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    return files.select("name", "content").mapInArrow(run, "name string").count()


def write_texts(rows: DataFrame, name: Column, text: Column, folder: str, order: list[Column] = (), between: str = "\n") -> int:
    """Write a file for each ``name``: the texts of its rows in their order, one behind the other; returns the number of files.

    Rows are sorted by name and order and written as they come, a batch at a time, so a file
    may have any size; the texts are only made behind the shuffle, which moves what they are
    made of. Rows without a name or a text are left out. A file is moved to its name when it is
    whole, so a task that is repeated puts it there again.
    """
    keys = {"__name": name, **{f"__o{i}": o for i, o in enumerate(order)}}
    sorted_ = rows.withColumns(keys).filter("__name IS NOT NULL").repartition("__name").sortWithinPartitions(*keys)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        done, current, out = [], None, None

        def close():
            if out is not None:
                out.close()
                fs.move(f"{path}/.{current}.{attempt}", f"{path}/{current}")
                done.append(current)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(names):
                to = len(names) if names[-1] == names[at] else next(i for i in range(at, len(names)) if names[i] != names[at])
                head = between
                if names[at] != current:
                    close()
                    current, head = names[at], ""
                    out = fs.open_output_stream(f"{path}/.{current}.{attempt}", compression=None)
                out.write((head + between.join(texts[at:to])).encode())
                at = to
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(done)], names=["name"])

    texts = sorted_.select("__name", text.alias("text")).filter("text IS NOT NULL")
    return texts.mapInArrow(put, "name string").count()


def write_document(rows: DataFrame, order: list[Column], text: Column, folder: str, name: str, head: str = "[\n", between: str = ",\n", tail: str = "\n]\n", part_rows: int = 200_000) -> DataFrame:
    """Write one file of the texts of all rows in a total order, and return its parts (part, offset, bytes, records).

    Rows are range-sorted, and every range is written as a part by a task of its own. Their
    sizes give each part's offset in the document; one task then copies the parts behind each
    other, a buffer at a time, and moves the whole file to its name. Until then nothing is
    there under that name, and a task that is repeated writes the same bytes. Rows without a
    text are left out; no rows give a document of head and tail.
    """
    n = max(1, -(-rows.count() // part_rows))
    ranged = rows.select(*[o.alias(f"o{i}") for i, o in enumerate(order)], text.alias("text")).filter("text IS NOT NULL")
    # the order of the columns is kept apart from how they sort
    ranged = ranged.repartitionByRange(n, *[f"o{i}" for i in range(len(order))]).sortWithinPartitions(*[f"o{i}" for i in range(len(order))]).select("text")
    parts_in = f"{folder.rstrip('/')}/.{name}.parts"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, path = _open(parts_in)
        fs.create_dir(path, recursive=True)
        part, size, records = context.partitionId(), 0, 0
        temporary = f"{path}/.{part}.{context.taskAttemptId()}"
        with fs.open_output_stream(temporary, compression=None) as f:
            for batch in batches:
                if not batch.num_rows:
                    continue
                data = ((between if records else "") + between.join(batch.column(0).to_pylist())).encode()
                f.write(data)
                size, records = size + len(data), records + batch.num_rows
        fs.move(temporary, f"{path}/{part:08d}")
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (part, size, records)], names=["part", "bytes", "records"])

    # a row for each range of part_rows
    parts = sorted(map(tuple, ranged.mapInArrow(put, "part long, bytes long, records long").collect()))
    offsets, at = [], len(head.encode())
    for part, size, records in parts:
        offsets.append((part, at, size, records))
        at += size + len(between.encode())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for _ in batches:
            pass
        fs, path = _open(folder)
        temporary = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(temporary, compression=None) as f:
            f.write(head.encode())
            for k, (part, offset, size, _) in enumerate(offsets):
                f.write(between.encode() if k else b"")
                if f.tell() != offset:
                    raise ValueError(f"{name}: a part is not where its sizes put it")
                with fs.open_input_stream(f"{path}/.{name}.parts/{part:08d}", compression=None) as g:
                    while data := g.read(1 << 20):
                        f.write(data)
            f.write(tail.encode())
        fs.move(temporary, f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    spark = rows.sparkSession
    spark.range(0, 1, 1, 1).mapInArrow(join, "name string").count()
    return spark.createDataFrame(offsets, "part long, offset long, bytes long, records long")
