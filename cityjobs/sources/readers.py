"""Readers of city data: CityGML text, terrain triangles, element JSON, sidecar JSON and packed terrain chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityjobs.operators import buildings as B
from cityjobs.sources.shared import written

ELEMENT = (
    "struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>,"
    "members:array<struct<type:string,ref:bigint,role:string,geometry:array<struct<lat:double,lon:double>>>>>"
)
#: How an element begins; within a string its quotes would be escaped, and members have ``ref`` in place of ``id``.
_ELEMENT = re.compile(r'\{\s*"type"\s*:\s*"(?:node|way|relation)"\s*,\s*"id"\s*:')
SIDECAR = "id array<string>, s array<int>, u array<string>, addr array<string>, tn array<string>"


def _one(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1)


def gml_buildings(spark: SparkSession, path: str, first_files: int | None = None) -> DataFrame:
    """A row for each building of ``*_op.gml`` files: mesh, file, seq, xml. Files are split at the end of a building.

    ``first_files`` takes that many files in the order of their names.
    """
    raw = spark.read.option("lineSep", "</bldg:Building>").option("pathGlobFilter", "*_op.gml").text(path)
    if first_files is not None:  # by the list of files alone; the others are not read
        there = spark.read.format("binaryFile").option("pathGlobFilter", "*_op.gml").load(path).filter("length > 0")
        first = there.select(F.col("_metadata.file_name").alias("file")).distinct().orderBy("file").limit(first_files)
        raw = raw.filter(F.col("_metadata.file_name").isin([r["file"] for r in first.collect()]))
    t = raw.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    t = t.withColumn("xml", F.regexp_extract("value", r"(?s)(<bldg:Building[ >].*)", 1)).filter("xml <> ''")
    return t.select(F.split("file", "_")[0].alias("mesh"), "file", F.struct("file", "start", "row").alias("seq"), "xml")


def building_attributes(xml: Column) -> dict[str, Column]:
    """id, name (from what stands before the first body), height, storeys, usage and address."""
    head = F.regexp_replace(xml, r"(?s)<bldg:(?:lod0|lod1|lod2|consistsOf|boundedBy).*", "")
    number = lambda p: F.coalesce(_one(xml, p).try_cast("double"), F.lit(0.0))
    return {
        "id": _one(xml, "<uro:buildingID>([^<]*)"), "name": F.trim(_one(head, "<gml:name>([^<]*)")), "h": number("<bldg:measuredHeight[^>]*>([^<]*)"),
        "s": number("<bldg:storeysAboveGround>([^<]*)").cast("int"), "u": _one(xml, "<bldg:usage[^>]*>([^<]*)"),
        "addr": F.concat(_one(xml, 'name="区名"><gen:value>([^<]*)'), _one(xml, 'name="町丁目名称"><gen:value>([^<]*)')),
    }


def _polygons(xml: Column) -> Column:
    """Polygons (ext, holes) in order; exteriors of fewer than 3 points are left out."""
    each = F.regexp_extract_all(xml, F.lit(r"(?s)<gml:Polygon[^>]*>(.*?)</gml:Polygon>"), F.lit(1))
    ring = lambda p, kind: F.regexp_extract_all(p, F.lit(rf"(?s)<gml:{kind}>.*?<gml:posList[^>]*>([^<]*)<"), F.lit(1))
    polys = F.transform(each, lambda p: F.struct(B.ring_of_numbers(F.get(ring(p, "exterior"), 0)).alias("ext"), F.transform(ring(p, "interior"), B.ring_of_numbers).alias("holes")))
    return F.filter(polys, lambda p: F.coalesce(F.size(p["ext"]), F.lit(0)) >= 3)


def lod1_solids(xml: Column) -> Column:
    """Prisms of a building's solids; those without a flat bottom or a height are left out."""
    solids = F.regexp_extract_all(xml, F.lit(r"(?s)<bldg:lod1Solid>(.*?)</bldg:lod1Solid>"), F.lit(1))
    return F.filter(F.transform(solids, lambda s: B.solid_of_polygons(_polygons(s))), lambda s: s.isNotNull())


def lod2_surfaces(xml: Column) -> Column:
    """Polygons of roofs, walls and outer ceilings and floors; ground surfaces are never seen."""
    kinds = F.array(*[F.lit(k) for k in ("RoofSurface", "WallSurface", "OuterCeilingSurface", "OuterFloorSurface")])
    of_kind = lambda k: F.regexp_extract_all(xml, F.concat(F.lit("(?s)<bldg:"), k, F.lit("[ >](.*?)</bldg:"), k, F.lit(">")), F.lit(1))
    multi = lambda x: F.regexp_extract_all(x, F.lit("(?s)<bldg:lod2MultiSurface>(.*?)</bldg:lod2MultiSurface>"), F.lit(1))
    surfaces = F.flatten(F.transform(F.flatten(F.transform(kinds, of_kind)), multi))
    return F.flatten(F.transform(surfaces, _polygons))


def chosen_surfaces(xml: Column, in_ground: Column, lod2_all: bool = False) -> Column:
    """The surfaces of buildings in grounds, or of all with ``lod2_all``, that are modelled with them; an empty list means the solids."""
    modelled = (in_ground | F.lit(lod2_all)) & F.contains(xml, F.lit("<bldg:lod2Solid"))
    point = "struct<lat:double,lon:double,z:double>"
    none = F.array().cast(f"array<struct<ext:array<{point}>,holes:array<array<{point}>>>>")
    return F.coalesce(lod2_surfaces(F.when(modelled, xml)), none)  # only what is modelled is searched


def tin_triangles(spark: SparkSession, path: str) -> DataFrame:
    """Vertices (lat, lon, z) of all triangles, the closing points left out."""
    raw = spark.read.option("lineSep", "</gml:posList>").option("pathGlobFilter", "*_op.gml").text(path)
    pts = B.ring_of_numbers(F.regexp_extract("value", r"(?s)<gml:posList[^>]*>([^<]*)$", 1))
    return raw.filter(F.col("value").rlike(r"<gml:posList[^>]*>[^<]*$")).select(F.explode(pts).alias("p")).select("p.*")


def _cut_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, start, n, whole, text): the elements that begin in each split, and what the split begins with (n = -1).

    Of the last element of a split (whole is false) more may follow in the next one.
    """
    split, n, held = None, -1, []

    def rows(found):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["file", "start", "n", "whole", "text"])

    for batch in batches:
        keys = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True))
        values = batch.column("value").to_pylist()
        at, found = 0, []
        while at < len(keys):
            to = at + next((i for i, k in enumerate(keys[at:]) if k != keys[at]), len(keys) - at)
            if keys[at] != split:
                if split is not None:
                    found.append((*split, n, False, "".join(held)))
                split, n, held = keys[at], -1, []
            text = "}".join(values[at:to]) + "}"  # the reader takes off what ends a record
            marks = [m.start() for m in _ELEMENT.finditer(text)]  # a beginning has no brace that closes, so it lies within a record
            for k, (a, b) in enumerate(zip([0, *marks], [*marks, len(text)], strict=True)):
                if k:  # an element begins here, which ends what was open
                    found.append((*split, n, n >= 0, "".join(held)))
                    n, held = n + 1, []
                held.append(text[a:b])
            at = to
        if found:
            yield rows(found)
    if split is not None:
        yield rows([(*split, n, False, "".join(held))])


def osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """A row for each element of element documents: file, seq (its place in the document) and the element's fields.

    A document of any size is read by as many tasks as it has splits, whether it is one line
    or many: records end at each closing brace, and a task finds the elements that begin in
    its split by how elements begin (type, then id). What a split begins with completes the last
    element of the one before: a row or two for each split.
    """
    raw = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    cut = written(raw.mapInArrow(_cut_elements, "file string, start long, n long, whole boolean, text string"), "element-texts")
    in_file = Window.partitionBy("file")
    # pieces of elements over borders: an open one and what the splits after it begin with
    pieces = cut.filter("NOT whole OR n < 0").withColumn("g", F.sum((F.col("n") >= 0).cast("int")).over(in_file.orderBy("start", "n")))
    pieces = pieces.groupBy("file", "g").agg(F.array_sort(F.collect_list(F.struct("start", "n", "text"))).alias("p")).filter(F.get("p", 0)["n"] >= 0)
    joined = pieces.select("file", F.get("p", 0)["start"].alias("start"), F.get("p", 0)["n"].alias("n"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    texts = cut.filter("whole AND n >= 0").select("file", "start", "n", "text").unionByName(joined)
    counts = cut.groupBy("file", "start").agg((F.max("n") + 1).alias("k"))
    before = F.coalesce(F.sum("k").over(in_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each split
    placed = texts.join(counts.select("file", "start", before.alias("before")), ["file", "start"])
    e = placed.select("file", (F.col("before") + F.col("n")).alias("seq"), F.from_json("text", ELEMENT).alias("e"))
    return e.select("file", "seq", "e.*")


def sidecar_features(spark: SparkSession, path: str) -> DataFrame:
    """A row for each feature of ``<mesh>_<cls>.json`` files; its place is its id in the tile."""
    files = spark.read.schema(SIDECAR).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    name = F.col("_metadata.file_name")
    return B.features_of_sidecars(files.withColumns({"mesh": F.regexp_extract(name, "^([0-9]{8})", 1), "cls": F.regexp_extract(name, r"_([td])\.json$", 1)}))


def chunk_cells(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Cells (cr, cc, y, x, z_dm) of packed chunks ``c_<row>_<col>.bin`` of little-endian 16-bit heights."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "c_*.bin").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.divmod(np.arange((size + 1) ** 2), size + 1)
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cr, cc = p.rpartition("c_")[2].removesuffix(".bin").split("_")
                z = np.frombuffer(content, "<i2")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), int(cr))), pa.array(np.full(len(z), int(cc))), pa.array(y), pa.array(x), pa.array(z.astype(np.int32))], names=["cr", "cc", "y", "x", "z_dm"])

    return files.mapInArrow(run, "cr long, cc long, y long, x long, z_dm int")


def refreshed(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Write unless it is there, or anyway with ``force``; the table that is there then."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
