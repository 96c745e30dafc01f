"""The products of the library from end to end: each a chain of operators over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityjobs.functions import geo
from cityjobs.operators import buildings as B
from cityjobs.operators import heights as H
from cityjobs.operators import labels as L
from cityjobs.operators import osm as O
from cityjobs.operators import spatial as S
from cityjobs.operators import terrain as T
from cityjobs.sources.shared import written

TALL = 25.0


def building_table(buildings: DataFrame, grounds: DataFrame, grid: T.Grid) -> DataFrame:
    """Buildings (pid, seq, lat, lon, base, top, name) with ground, cls (t: tall or in a ground), mesh, batch_id and terrain cell.

    Sidecars, the manifest, ground samples, footprints and statistics are made of its rows.
    """
    b = S.innermost_area(buildings, grounds)
    cls = F.when((F.col("top") - F.col("base") >= TALL) | F.col("ground").isNotNull(), "t").otherwise("d")
    cell = geo.grid_cell(F.col("lat"), F.col("lon"), grid.north, grid.west, grid.res, grid.cols)[2]
    return B.batch_ids(b.withColumns({"cls": cls, "mesh": geo.mesh_code(F.col("lat"), F.col("lon")), "cell": cell}))


def terrain_cells(dem: DataFrame, building_bases: DataFrame, vertices: DataFrame, grid: T.Grid) -> DataFrame:
    """Cells (r, c, z) of raw heights, moved to the bases (r, c, base) of buildings, then replaced by the means of terrain vertices."""
    samples = T.upper_median(building_bases, ["r", "c"], "base").select("r", "c", F.col("median").alias("s"))
    moved = T.corrected(dem, samples, grid).select("r", "c", "z")
    return T.overridden(moved, T.mean_of_vertices(vertices, grid)).select("r", "c", "z")


def infill_table(ways: DataFrame, grounds: DataFrame, footprints: DataFrame, points: DataFrame, heights: H.Heights) -> DataFrame:
    """Buildings added to grounds, and observation towers outside, where no known one is: id, area, mesh, ground, base, top, surfaces.

    ``ways`` are closed (id, lat, lon, geometry, box, tags); heights come from their tags.
    """
    part = O.has("building:part")
    w = S.innermost_area(ways.withColumns({"pid": F.col("id"), "ring": F.slice("geometry", 1, F.size("geometry") - 1), "is_part": part}), grounds).drop("pid")
    tower = O.has("building") & (O.tag("man_made") == "tower") & (O.tag("tower:type") == "observation") & (O.lenient_number(O.tag("height")) >= 30)
    items = w.filter(F.col("ground").isNotNull() | F.coalesce(tower, F.lit(False))).withColumnRenamed("ground", "area")
    items = written(items, "infill-items")
    added = O.infill(items, footprints, points).filter("fate = 'added'").withColumns({"ring": O.simplified("ring"), **O.building_heights()})
    added = written(added.filter(F.size("ring") >= 3), "infill-added")
    added = added.join(H.lowest_under(added.select("id", "ring"), heights, "id"), "id")
    added = written(added.withColumns({"base": F.col("ground") + F.col("min_h"), "top": F.col("ground") + F.col("h"), "mesh": geo.mesh_code(F.col("lat"), F.col("lon"))}), "infill-rows")
    across = F.coalesce(O.tag("roof:orientation") == "across", F.lit(False))
    eave, roof = O.roof_surfaces(F.col("ring"), F.col("base"), F.col("top"), F.col("shape"), F.col("rh"), across)
    house = F.concat(O.wall_surfaces(F.col("ring"), F.col("base"), eave), roof)
    return added.withColumn("surfaces", F.when(F.col("area").isNotNull(), house).otherwise(O.tower_surfaces(F.col("ring"), F.col("base"), F.col("top"))))


_FIELDS = {"k": "string", "seq": "long", "ja": "string", "lat": "double", "lon": "double", "z": "double", "r": "int", "e": "double", "g": "int", "w": "string"}
_ENGLISH = {"known": "string", "look": "string", "how": "string", "lead": "string"}


def _label(df: DataFrame, kind: Column | str, part: int, known: Column, how: str = "t", look: Column | None = None, lead: Column | None = None, **fields: Column) -> DataFrame:
    """Columns of a label; ``seq`` keeps the order of the parts and of the rows in each. English: as known, else ``lead`` and the translation of ``look``."""
    columns = {"k": F.lit(kind) if isinstance(kind, str) else kind, "seq": F.lit(part << 56) + F.col("seq"), **fields}
    columns |= {"known": F.coalesce(known, F.lit("")), "how": F.lit(how), "look": fields["ja"] if look is None else look, "lead": F.lit("") if lead is None else lead}
    return df.select(*[columns.get(k, F.lit(None) if k in ("e", "g", "w") else F.col(k)).cast(t).alias(k) for k, t in (_FIELDS | _ENGLISH).items()])


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def anchored_grounds(grounds: DataFrame, points: DataFrame) -> DataFrame:
    """Grounds with ``tallest``: the highest building in their rings, or, where a ground has none, the nearest within 30 metres."""
    drawn = F.coalesce(F.size("rings"), F.lit(0)) > 0
    inside = S.tallest_inside(grounds.filter(drawn), points)
    near = S.nearest_within(grounds.filter(~drawn).withColumn("qid", F.col("i")), points, 30.0).withColumnRenamed("nearest", "tallest").drop("qid", "dist")
    return inside.unionByName(near)


def label_table(peaks: DataFrame, grounds: DataFrame, elements: DataFrame, facilities: DataFrame, points: DataFrame, heights: H.Heights) -> DataFrame:
    """Labels (k, ja, en, lat, lon, z, r, e, g, w, place): peaks, grounds, landmarks and stations, named buildings, in order, each name once in 300 metres.

    peaks (seq, name, lat, lon, ele, wikidata[, name_en]), grounds (i, name, rel, r, lat, lon,
    rings, area, box[, en, wikipedia]), elements of landmarks (type, id, seq, lat, lon, tags, geometry,
    members), facilities (seq, name, lat, lon, base, top) and all buildings as ``points`` (seq, lat, lon, base, top).
    """
    p = H.highest_around(peaks, heights).filter(L.keep_peak(F.col("hz"), F.col("ele")))
    f = L.peak_fields(F.col("name"), O.lenient_number(F.col("ele")), F.col("hz"), F.col("wikidata"))
    mount = F.when(f["base"] == F.col("name"), "").otherwise("Mt. ")
    out = _label(p, "p", 0, L.clean_english(_optional(p, "name_en")), "r", f["base"], mount, ja=F.col("name"), **{k: f[k] for k in ("z", "r", "e")})

    halls = points.select(F.col("seq").alias("tallest"), F.col("lat").alias("blat"), F.col("lon").alias("blon"), "base", "top")
    g = anchored_grounds(grounds, points).join(halls, "tallest", "left").withColumns({"lat": F.coalesce("blat", "lat"), "lon": F.coalesce("blon", "lon")})
    g = H.nearest_height(g, heights).withColumn("seq", F.col("i"))
    f = L.anchored_fields(F.col("top"), F.col("base"), F.col("ground"))
    wiki = F.nullif(_optional(g, "wikipedia"), F.lit(""))
    out = out.unionByName(_label(g, "t", 1, L.mapped_english(_optional(g, "en")), ja=F.col("name"), r=F.when(F.col("rel") == 4, 1).otherwise(F.col("r")), g=F.col("rel"), w=wiki, **f))

    a = written(H.nearest_height(O.anchored_landmarks(elements, points), heights).withColumn("name", O.tag("name")), "landmarks")
    f = L.anchored_fields(F.col("top"), F.col("base"), F.col("ground"))
    en = L.mapped_english(O.tag("name:en"))
    station = F.coalesce(O.tag("railway") == "station", F.lit(False))
    s = L.last_accepted(a.filter(station).withColumns({"z": f["z"], "own_en": en}).select("name", "seq", "lat", "lon", "z", "own_en"))
    names = L.station_names(F.col("name"), F.col("own_en"))
    out = out.unionByName(_label(s, "s", 2, F.when(F.col("own_en") != "", names["en"]), "r", ja=names["ja"], r=F.lit(2)))
    sights = a.filter(~station & ~L.uninformative(F.col("name")) & ~F.coalesce(O.tag("amenity") == "place_of_worship", F.lit(False)))
    sights = sights.join(grounds.select("name").distinct(), "name", "left_anti").withColumns(O.notable_fields())
    sights = sights.filter(L.keep_landmark(F.col("notable"), F.col("h"), F.col("sight"), O.tag("name:en"))).withColumn("pid", F.concat_ws("/", "type", "id"))
    inside = S.innermost_area(sights.drop("ground"), grounds).withColumnRenamed("ground", "area")
    inside = inside.join(grounds.select(F.col("i").alias("area"), F.col("name").alias("area_name")), "area", "left")
    known = H.nearest_height(inside, heights)
    rank = L.landmark_rank(F.col("h"), F.col("major"), F.col("notable"), F.col("area").isNotNull(), F.col("name") != F.col("area_name"))
    out = out.unionByName(_label(known, "l", 2, en, ja=F.col("name"), r=rank, **f))

    out = written(out, "known-labels")
    taken = L.beside_known_labels(facilities.withColumnRenamed("seq", "id"), out).select(F.col("id").alias("seq"))
    free = L.suppressed_facilities(facilities.join(taken, "seq", "left_anti").withColumn("id", F.col("seq")))
    # English of the map's element of the same name within 500 metres, where the element itself stands
    lat, lon = O.element_position()
    entries = elements.select(O.tag("name").alias("name"), "seq", lat.alias("nlat"), lon.alias("nlon"), en.alias("en")).filter("en <> '' AND nlat IS NOT NULL AND nlon IS NOT NULL")
    free = free.join(L.english_by_name(free.select("id", "name", "lat", "lon"), entries).select("id", F.col("en").alias("own_en")), "id", "left").drop("id")
    f = L.facility_fields(F.col("name"), F.col("top"), F.col("base"))
    own = F.when(F.col("name").endswith("駅"), L.station_names(F.col("name"), F.col("own_en"))["en"]).otherwise(F.col("own_en"))
    out = out.unionByName(_label(free, f.pop("k"), 3, own, ja=F.col("name"), **f))
    placed = L.ordered_places(out, [F.col("r"), F.coalesce("e", F.lit(0.0)).desc(), F.col("seq")])
    return L.with_english(L.greedy_same_name(placed.withColumn("ord", F.col("place"))).drop("ord", "seq"))
