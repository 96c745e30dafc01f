"""A deterministic sharded WARC writer and its reader.

Payloads are compared by their SHA-256; of equal ones the record of the largest page id is
the response and the others are revisits of it. Every record becomes one gzip member with
regenerated headers and digests. Records are range-sorted by page id, and the running sum
of their compressed sizes in that order says which file each belongs to, so the files do
not depend on how the input was split. A file is written under a temporary name and
renamed; a manifest lists the files, and readers take only what it lists.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, before_each, materialize, shared_dir, ship, with_rows
from .storage import read_file, write_committed

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed size at which a file is full.
ROLL_BYTES = 8 << 20
#: Files whose bounds are broadcast (under 100 bytes each); where there are more, members are joined to their files.
MAX_BOUNDS = 1 << 20
_SPACE = uuid.UUID(int=0)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{digest}|{copy}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, copy: int, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC record as a gzip member of its own; a revisit keeps the HTTP head and leaves the payload out."""
    digest = sha1_base32(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 0)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", str(refers_to))]
        if refers_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", " ".join(refers_url.split())))
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of a file of gzip members."""
    while data:
        d = zlib.decompressobj(wbits=31)
        raw = d.decompress(data)
        data = d.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0][:40]}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        block = rest[: int(fields["content-length"])]
        if rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("a record's length does not match")
        yield fields, block


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            cols = part.to_pydict()
            made = [
                build_record(p, u, (h or "").encode(), c, r, ru)
                for p, u, h, c, r, ru in zip(cols["page_id"], cols["url"], cols["html"], cols["copy"], cols["refers_to"], cols["refers_url"], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("copy"), pa.array(made, pa.binary()), pa.array([len(m) for m in made], pa.int64())], names=["page_id", "copy", "member", "size"]
            )


def _numbered(rows: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """Rows (page_id, hash, url, place) that repeat, without their html, with ``copy``: a number within each (page_id, hash), from 0.

    All may be copies of one: they are numbered in ranges of their order, and a range's
    numbers go on from those of the ranges before it.
    """
    order = ["page_id", "hash", "url", ROW]
    rows = materialize(rows, "repeated-rows")
    ranged = rows.repartitionByRange(max(1, -(-rows.count() // range_rows)), *order)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "repeated-ranges")
    counts = ranged.groupBy("page_id", "hash", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("page_id", "hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = counts.select(F.col("page_id").alias("rid"), F.col("hash").alias("rhash"), F.col("part").alias("rpart"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("part", "page_id", "hash").orderBy("url", ROW)) - 1
    placed = ranged.withColumn("at", at).join(before, F.col("page_id").eqNullSafe(F.col("rid")) & (F.col("hash") == F.col("rhash")) & (F.col("part") == F.col("rpart")))
    return materialize(placed.select(ROW, (F.col("at") + F.col("before")).cast("int").alias("copy")), "copies")


def write_warc(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = ROLL_BYTES) -> str:
    """Write a record for every page and return the archive's folder; its manifest is committed last.

    * Null html is an empty payload; empty payloads are compared like others.
    * Rows that repeat an id and a payload are records of their own, told apart by a copy
      number; those of the largest id are all responses.
    * Null ids sort first, have no page header, and never win against another id.
    * An empty table gives a manifest without files; other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    ship(spark)
    path = path or shared_dir(spark, "warc")

    def records(of: DataFrame, *more: str) -> DataFrame:
        r = of.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), *more)
        return r.withColumn("hash", F.sha2(F.encode("html", "UTF-8"), 256))

    rows = records(pages)
    light = rows.select("page_id", "url", "hash")
    winners = light.groupBy("hash").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash", "winner")
    winners = materialize(winners, "winners")
    urls = materialize(
        light.join(winners.select("hash", F.col("winner").alias("page_id")), ["hash", "page_id"]).groupBy("hash", F.col("page_id").alias("winner")).agg(F.min("url").alias("refers_url")),
        "winner-urls",
    )
    # copies are counted only among ids that repeat
    repeated = materialize(light.groupBy("page_id", "hash").count().filter("count > 1").select(F.col("page_id").alias("rid"), F.col("hash").alias("rhash")), "repeats")
    if repeated.isEmpty():
        rows = rows.withColumn("copy", F.lit(0))
    else:
        rows = records(with_rows(pages), ROW)
        same = F.col("page_id").eqNullSafe(F.col("rid")) & (F.col("hash") == F.col("rhash"))
        copies = _numbered(rows.select("page_id", "hash", "url", ROW).join(repeated, same).drop("rid", "rhash"))
        rows = rows.join(copies.select(F.col(ROW).alias("__at"), "copy"), F.col(ROW) == F.col("__at"), "left").withColumn("copy", F.coalesce("copy", F.lit(0)))
    rows = rows.join(urls, "hash", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    rows = rows.select("page_id", "url", "html", F.col("copy").cast("int").alias("copy"), refers.alias("refers_to"), F.when(refers.isNotNull(), F.col("refers_url")).alias("refers_url"))

    members = materialize(rows.mapInArrow(_members, "page_id long, copy int, member binary, size long"), "members")
    # range-sorted runs, then a running sum of sizes within and before each run
    n_runs = max(1, -(-(members.agg(F.sum("size")).first()[0] or 0) // (4 * roll_bytes)))
    runs = members.select("page_id", "copy", "size").repartitionByRange(n_runs, F.col("page_id").asc_nulls_first(), "copy")
    runs = materialize(runs.withColumn("run", F.spark_partition_id()), "runs")
    starts = materialize(before_each(runs.groupBy("run").agg(F.sum("size").alias("s")), "run", F.col("s"), "before"), "run-starts")
    within = Window.partitionBy("run").orderBy(F.col("page_id").asc_nulls_first(), "copy").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = runs.join(starts, "run").withColumn("file_no", F.floor(upto / roll_bytes).cast("long")).select("page_id", "copy", "size", "file_no")
    bounds = materialize(placed.groupBy("file_no").agg(F.min(F.struct("page_id", "copy")).alias("first")), "bounds")
    columns = "page_id long, copy int, member binary, size long, file_no long"
    if bounds.count() > MAX_BOUNDS:
        at = placed.select(F.col("page_id").alias("rid"), F.col("copy").alias("rcopy"), "file_no").hint("merge")
        files = members.join(at, F.col("page_id").eqNullSafe(F.col("rid")) & (F.col("copy") == F.col("rcopy"))).drop("rid", "rcopy")
    else:
        # a file is a range of the order, so its bounds place the members without a join of theirs
        firsts = bounds.select("file_no", F.col("first.page_id").alias("p"), F.col("first.copy").alias("c")).sort("file_no").toArrow()
        starts_at = [(-(1 << 63) - 1 if p is None else p, c) for p, c in zip(firsts["p"].to_pylist(), firsts["c"].to_pylist(), strict=True)]
        given = spark.sparkContext.broadcast((starts_at, firsts["file_no"].to_pylist()))

        def to_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import bisect

            keys, numbers = given.value
            for batch in batches:
                ids, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                at = [numbers[bisect.bisect_right(keys, (-(1 << 63) - 1 if p is None else p, c)) - 1] for p, c in zip(ids, copies, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=["page_id", "copy", "member", "size", "file_no"])

        files = members.mapInArrow(to_files, columns)

    def write(table: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        order = pc.sort_indices(table, sort_keys=[("page_id", "ascending"), ("copy", "ascending")], null_placement="at_start")
        number = table.column("file_no")[0].as_py()
        name = f"part-{number:08d}.warc.gz"
        data = b"".join(table.column("member").take(order).to_pylist())
        context = TaskContext.get()
        write_committed(path, name, str(context.taskAttemptId() if context else 0), data)
        return pa.table({"file": [name], "records": pa.array([table.num_rows], pa.int64()), "bytes": pa.array([len(data)], pa.int64()), "sha256": [hashlib.sha256(data).hexdigest()]})

    files = files.groupBy("file_no").applyInArrow(write, "file string, records long, bytes long, sha256 string")
    files.write.parquet(f"{path}/_manifest")
    return path


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows (page_id, url, record_id, record_type, payload_digest, payload_bytes, refers_to, file) of an archive.

    Only files in the manifest are read; sizes, file digests, block digests and the payload
    digests of responses are checked, and a mismatch fails the job.
    """
    ship(spark)
    manifest = spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{path}/_manifest")
    names = ["page_id", "url", "record_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "file"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = read_file(path, row["file"])
                if hashlib.sha256(data).hexdigest() != row["sha256"]:
                    raise ValueError(f"{row['file']} differs from its manifest")
                out: list[list] = [[] for _ in names]
                for h, block in parse_records(data):
                    if h["warc-block-digest"] != "sha1:" + sha1_base32(block):
                        raise ValueError(f"{row['file']}: a block differs from its digest")
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    if h["warc-type"] == "response" and (digest != sha1_base32(payload) or size != len(payload)):
                        raise ValueError(f"{row['file']}: a payload differs from its digest")
                    page, refers = h.get("x-page-id"), h.get("x-refers-to-page-id")
                    values = [page and int(page), h.get("warc-target-uri"), h["warc-record-id"], h["warc-type"], digest, size, refers and int(refers), row["file"]]
                    for col, v in zip(out, values, strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    n_files = max(1, manifest.count())
    schema = "page_id long, url string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to long, file string"
    return manifest.repartition(min(n_files, 4096)).mapInArrow(read, schema)
