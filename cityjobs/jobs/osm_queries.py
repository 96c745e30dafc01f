"""Queries of the OpenStreetMap operators, over elements made of the derived ways, landmarks and peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityjobs.functions import geo
from cityjobs.jobs import inputs as I
from cityjobs.jobs.inputs import SQL_B, SQL_DEM, SQL_E, SQL_G, SQL_W, sql_dist
from cityjobs.jobs.registry import query
from cityjobs.jobs.spatial_queries import MESH, SQL_IN
from cityjobs.operators import heights as H
from cityjobs.operators import labels as L
from cityjobs.operators import osm as O
from cityjobs.operators import spatial as S
from cityjobs.sources.shared import written

BOX = (34.6, 135.4, 34.75, 135.58)


def _tags(**tags):
    """A map of the tags whose value is not null."""
    pairs = F.array(*[F.struct(F.lit(k.replace("__", ":")).alias("key"), v.cast("string").alias("value")) for k, v in tags.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def elements(spark, sf):
    """type, id, seq, lat, lon, tags, geometry."""
    lm = I.named_points(spark, sf, "fx_landmarks")
    i = F.col("id")
    none = F.lit(None).cast(O.POINTS)
    lm = lm.select(F.lit("node").alias("type"), "id", (i * 3).alias("seq"), "lat", "lon", _tags(
        name=F.col("name"), railway=F.when(F.col("is_station"), "station"), wikidata=F.when(F.col("notable"), F.concat(F.lit("Q"), i)), name__en=F.col("name_en"),
        tourism=F.when(i % 5 == 0, "museum").when(i % 5 == 1, "hotel"), historic=F.when(i % 7 == 0, F.get(F.array(*[F.lit(k) for k in (*O.HISTORIC_KINDS, "ruins", "wreck")]), (i / 7).cast("int") % 9)).when(i % 29 == 0, "castle"), leisure=F.when(i % 11 == 0, "park").when(i % 11 == 1, "pitch"), landuse=F.when(i % 15 == 0, "religious"),
        amenity=F.when(i % 9 == 0, "place_of_worship"), wikipedia=F.when(i % 13 == 0, F.concat(F.lit("ja:"), F.col("name"))), heritage=F.when(i % 17 == 0, "2"),
        religion=F.when(i % 10 == 0, "buddhist").when(i % 10 == 1, "shinto").when(i % 10 == 2, "christian"), heritage__operator=F.when(i % 34 == 0, "whc"),
    ).alias("tags"), none.alias("geometry"))
    pk = I.named_points(spark, sf, "fx_peaks")
    pk = pk.select(F.lit("node").alias("type"), (i + 10_000_000).alias("id"), (i * 3 + 1).alias("seq"), "lat", "lon", _tags(
        name=F.col("name"), natural=F.when(i % 3 == 0, "peak").when(i % 3 == 1, "volcano").otherwise("saddle"), ele=F.col("ele_tag"), wikidata=F.when(F.col("wikidata"), F.concat(F.lit("Q"), i))
    ).alias("tags"), none.alias("geometry"))
    w = I.ways(spark, sf)
    ring = F.when(i % 13 == 0, F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    w = w.select(F.lit("way").alias("type"), "id", (i * 3 + 2).alias("seq"), "lat", "lon", _tags(
        building=F.when(~F.col("is_part"), F.col("btype")), building__part=F.when(F.col("is_part"), "yes"), height=F.col("height_tag"), building__levels=F.col("levels_tag"),
        name=F.when(i % 4 == 0, F.concat(F.lit("建物"), i)), roof__shape=F.when(i % 8 == 0, "gabled").when(i % 8 == 1, "pyramidal").when(i % 8 == 2, "flat"), roof__levels=F.when(i % 9 == 0, "1"),
        min_height=F.when(i % 7 == 0, "2,5"), man_made=F.when((i % 6 == 0) | (i % 20 == 13), "tower"), tower__type=F.when((i % 12 == 0) | (i % 20 == 13), "observation"),
    ).alias("tags"), ring.alias("geometry"))
    return lm.unionByName(pk).unionByName(w)


def relations(spark, sf):
    """A relation for every tenth way: its ring as the outer member, and three points of it as the inner one."""
    w = I.ways(spark, sf).filter("id % 10 = 0")
    member = lambda role, g: F.struct(F.lit("way").alias("type"), F.col("id").alias("ref"), F.lit(role).alias("role"), g.alias("geometry"))
    none = F.lit(None)
    tags = _tags(type=F.lit("multipolygon"), name=F.concat(F.lit("集まり"), F.col("id")), building=F.lit("yes"))
    return w.select(F.lit("relation").alias("type"), "id", F.col("id").alias("seq"), none.cast("double").alias("lat"), none.cast("double").alias("lon"), tags.alias("tags"), none.cast(O.POINTS).alias("geometry"), F.array(member("outer", F.col("ring")), member("inner", F.slice("ring", 1, 3))).alias("members"))


def all_elements(spark, sf):
    """Nodes, ways and relations."""
    r = relations(spark, sf)
    return elements(spark, sf).withColumn("members", F.lit(None).cast(r.schema["members"].dataType)).unionByName(r)


_L = "l AS (SELECT id, lat_u / 1e6 AS lat, lon_u / 1e6 AS lon, name, is_station, notable, name_en FROM fx_landmarks)"
_PK = "pk AS (SELECT id, lat_u / 1e6 AS lat, lon_u / 1e6 AS lon, name, ele_tag, wikidata FROM fx_peaks)"
_IN = "lat BETWEEN 34.6 AND 34.75 AND lon BETWEEN 135.4 AND 135.58"


@query("flt1_osm_peaks", f"WITH {_PK} SELECT id + 10000000 AS id FROM pk WHERE id % 3 < 2 AND {_IN}")
def flt1(spark, sf):
    return O.peaks(elements(spark, sf), BOX).select("id")


_LM = f"""SELECT 'node' AS type, id FROM l WHERE {_IN} AND (id % 5 = 0 OR (id % 7 = 0 AND CAST(floor(id / 7) AS INTEGER) % 9 < 7) OR (id % 29 = 0 AND id % 7 <> 0) OR is_station OR (id % 11 = 0 AND notable))
UNION ALL SELECT 'way', id FROM w WHERE {_IN} AND id % 4 = 0 AND (NOT is_part OR id % 6 = 0)"""


@query("flt2_osm_landmarks", f"WITH {_L}, {SQL_W} {_LM}")
def flt2(spark, sf):
    return O.landmarks(elements(spark, sf), BOX).select("type", "id")


_SG = f"SELECT id FROM l WHERE {_IN} AND ((id % 9 = 0 AND (id % 13 = 0 OR notable)) OR (id % 15 = 0 AND id % 13 = 0) OR (((id % 29 = 0 AND id % 7 <> 0) OR (id % 7 = 0 AND CAST(floor(id / 7) AS INTEGER) % 9 = 0)) AND id % 13 = 0))"


@query("flt3_sacred_grounds", f"WITH {_L} {_SG}")
def flt3(spark, sf):
    return O.sacred_grounds(elements(spark, sf), BOX).select("id")


@query("flt5_closed_ways", f"WITH {SQL_W} SELECT id FROM w WHERE id % 13 <> 0")
def flt5(spark, sf):
    return O.closed_ways(elements(spark, sf)).select("id")


_H = """num AS (SELECT *, TRY_CAST(regexp_extract(replace(height_tag, ',', '.'), '^[0-9.]+') AS DOUBLE) AS th, TRY_CAST(levels_tag AS DOUBLE) AS lv FROM w),
hh AS (SELECT *, coalesce(th, CASE WHEN lv <> 0 THEN lv * 3.5 + 2 END, CASE WHEN is_part THEN 6.0 ELSE CASE btype WHEN 'temple' THEN 10.0 WHEN 'shrine' THEN 8.0 WHEN 'gate' THEN 7.0 WHEN 'pagoda' THEN 20.0 ELSE 6.0 END END)::DOUBLE AS h FROM num),
hm AS (SELECT *, least(h - 0.5, CASE WHEN id % 7 = 0 THEN 2.5 ELSE 0.0 END)::DOUBLE AS min_h, CASE WHEN id % 8 = 0 THEN 'gabled' WHEN id % 8 = 1 THEN 'pyramidal' WHEN id % 8 = 2 THEN 'flat' WHEN is_part THEN 'flat' ELSE 'hipped' END AS shape FROM hh),
ht AS (SELECT *, CASE WHEN shape = 'flat' THEN 0.0 ELSE least(CASE WHEN id % 9 = 0 THEN 3.0 ELSE (h - min_h) * 0.4 END, h - min_h) END::DOUBLE AS rh, coalesce(lv, 0.0)::DOUBLE AS levels FROM hm)"""


_WIN = f"""b AS (SELECT id, lat, lon FROM w), {SQL_E}, {SQL_G}, {SQL_IN}"""


@query("flt6_observation_towers", f"WITH {SQL_W}, {_H}, {_WIN} SELECT id FROM ht WHERE (id % 12 = 0 OR id % 20 = 13) AND NOT is_part AND th >= 30 AND id NOT IN (SELECT id FROM own)")
def flt6(spark, sf):
    """Towers within a ground are not among them."""
    return O.observation_towers(elements(spark, sf), I.grounds(spark, sf)).select("id")


@query("fn15_ground_religion", f"""WITH {_L} SELECT id, CAST(CASE WHEN (id % 29 = 0 AND id % 7 <> 0) OR (id % 7 = 0 AND CAST(floor(id / 7) AS INTEGER) % 9 = 0) THEN 4 WHEN id % 10 = 0 THEN 1 WHEN id % 10 = 1 THEN 2 WHEN id % 10 = 2 THEN 3 WHEN name LIKE '%宮' THEN 2 WHEN name LIKE '%寺' THEN 1 ELSE 3 END AS INTEGER) AS rel FROM l
UNION ALL SELECT i + 20000000, CAST(CASE i % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 3 END AS INTEGER) FROM fx_grounds""")
def fn15(spark, sf):
    from cityjobs.sources.fixtures import fixture

    e = elements(spark, sf).filter("type = 'node' AND id < 10000000").select("id", O.religion(O.tag("name")).alias("rel"))
    g = fixture(spark, sf, "fx_grounds").select((F.col("i") + 20_000_000).alias("id"), F.regexp_replace("name", "[0-9]+$", "").alias("name")).withColumn("tags", _tags(name=F.col("name")))
    return e.unionByName(g.select("id", O.religion(F.col("name")).alias("rel")))


@query("fn16_ground_rank", f"WITH {_L} SELECT id, CAST(CASE WHEN id % 34 = 0 THEN 1 WHEN id % 17 = 0 OR (notable AND name_en IS NOT NULL) THEN 2 ELSE 3 END AS INTEGER) AS r, CASE WHEN id % 34 = 0 THEN 'whc' WHEN id % 17 = 0 THEN 'heritage' ELSE '' END AS heritage FROM l")
def fn16(spark, sf):
    rank, label = O.ground_rank()
    return elements(spark, sf).filter("type = 'node' AND id < 10000000").select("id", rank.alias("r"), label.alias("heritage"))


@query("fn17_lenient_number", f"WITH {SQL_W}, {_H} SELECT id, th AS h, lv FROM num")
def fn17(spark, sf):
    return I.ways(spark, sf).select("id", O.lenient_number(F.col("height_tag")).alias("h"), O.lenient_number(F.col("levels_tag")).alias("lv"))


def _ways(spark, sf):
    return elements(spark, sf).filter("type = 'way'").withColumns(O.building_heights())


@query("fn18_building_heights", f"WITH {SQL_W}, {_H} SELECT id, h, min_h, shape, round(rh, 9) AS rh, levels FROM ht")
def fn18(spark, sf):
    return _ways(spark, sf).select("id", "h", "min_h", "shape", F.round("rh", 9).alias("rh"), "levels")


def _infill(spark, sf):
    """Ways with heights, an open simplified ring and the ground under it."""
    w = _ways(spark, sf).withColumn("ring", O.simplified(F.slice("geometry", 1, 4))).filter(F.size("ring") >= 3)
    return w.join(H.lowest_under(w.select("id", "ring"), I.heights(spark, sf), "id"), "id")


_GR = """p AS (SELECT id, unnest([s, s, n, n]) AS lat, unnest([w, e, e, w]) AS lon FROM w),
gr AS (SELECT p.id, min(floor(z / 0.1::DOUBLE + 0.5) * 0.1::DOUBLE) AS ground FROM p JOIN dem ON dem.r = greatest(0, least(209, floor((34.78::DOUBLE - lat) / 0.001::DOUBLE))) AND dem.c = greatest(0, least(239, floor((lon - 135.37::DOUBLE) / 0.001::DOUBLE))) GROUP BY p.id)"""


@query("fn45_infill_rows", f"""WITH {SQL_DEM}, {SQL_W}, {_H}, {_GR} SELECT 'osm:way/' || id AS id, floor((ground + h - ground) * 10 + 0.5) / 10 AS h, levels AS s, round(ground, 6) AS ground, round(ground + min_h, 6) AS base, round(ground + h, 6) AS top FROM ht JOIN gr USING (id)""")
def fn45(spark, sf):
    w = _infill(spark, sf).withColumn("top", F.col("ground") + F.col("h"))
    return w.select(F.concat(F.lit("osm:way/"), "id").alias("id"), geo.round_half_up(F.col("top") - F.col("ground"), 1).alias("h"), F.col("levels").alias("s"), F.round("ground", 6).alias("ground"), F.round(F.col("ground") + F.col("min_h"), 6).alias("base"), F.round("top", 6).alias("top"))


@query("fn19_simplified_footprints")
def fn19(spark, sf):
    """Footprints with a vertex added on every edge lose these again."""
    r = F.col("ring")
    dense = F.flatten(F.transform(r, lambda p, i: F.array(p, F.struct(((p["lat"] + O._next(r, i)["lat"]) / 2).alias("lat"), ((p["lon"] + O._next(r, i)["lon"]) / 2).alias("lon")))))
    return I.ways(spark, sf).select("id", O.simplified(dense).alias("ring")).select("id", F.size("ring").alias("n"), "ring")


@query("fn14_assembled_rings")
def fn14(spark, sf):
    """Each footprint in two pieces, the second turned around, becomes one closed ring."""
    r = F.col("ring")
    pieces = F.array(F.slice(r, 1, 3), F.array(F.get(r, 0), F.get(r, 3), F.get(r, 2)))
    return I.ways(spark, sf).select("id", O.assembled(pieces).alias("rings")).select("id", F.size("rings").alias("n"), "rings")


_FACES = """pt AS (SELECT ht.*, rh > 0.3 AND shape <> 'flat' AS roofy, CASE WHEN rh > 0.3 AND shape <> 'flat' THEN h - rh ELSE h END AS eave, (n - s) * 111000.0::DOUBLE AS dn, (e - w) * 91280.04047475605::DOUBLE AS de FROM ht),
-- corners 0 .. 3 are (s, w), (s, e), (n, e), (n, w); a ridge along them if the sides to the east are the longer ones
rf AS (SELECT id, roofy, eave, shape, h, min_h, dn, de, s, w, n, e, CASE WHEN shape = 'gabled' THEN 0.0::DOUBLE WHEN greatest(dn, de) > least(dn, de) THEN least(dn, de) / 2 / greatest(dn, de) ELSE 0.5::DOUBLE END AS f FROM pt)"""


@query("fn20_walls_and_roofs", f"""WITH {SQL_W}, {_H}, {_FACES} SELECT id, CAST(4 + CASE WHEN roofy THEN 4 ELSE 1 END AS INTEGER) AS n, round(eave, 6) AS eave,
 round(CASE WHEN NOT roofy THEN eave WHEN shape IN ('gabled', 'hipped') THEN h ELSE h END, 6) AS top,
 round(CASE WHEN NOT roofy THEN n WHEN shape = 'pyramidal' THEN (s + n) / 2 WHEN de >= dn THEN (s + n) / 2 ELSE s + (n - s) * (1 - f) END, 7) AS lat,
 round(CASE WHEN NOT roofy THEN e WHEN shape = 'pyramidal' THEN (w + e) / 2 WHEN de >= dn THEN w + (e - w) * (1 - f) ELSE (w + e) / 2 END, 7) AS lon FROM rf""")
def fn20(spark, sf):
    """Number of polygons, eave, and the third point of the first roof polygon: a ridge's end, the apex, or a corner."""
    w = _ways(spark, sf).withColumn("open", F.slice("geometry", 1, 4))
    eave, roof = O.roof_surfaces(F.col("open"), F.col("min_h"), F.col("h"), F.col("shape"), F.col("rh"), F.lit(False))
    w = w.withColumns({"eave": eave, "roof": roof}).withColumn("walls", O.wall_surfaces(F.col("open"), F.col("min_h"), F.col("eave")))
    third = F.get(F.get("roof", 0), 2)
    return w.select("id", F.size(F.concat("walls", "roof")).alias("n"), F.round("eave", 6).alias("eave"), F.round(third["z"], 6).alias("top"), F.round(third["lat"], 7).alias("lat"), F.round(third["lon"], 7).alias("lon"))


@query("fn21_tower_surfaces", f"""WITH {SQL_W}, {_H}, lv AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 1.0::DOUBLE), (1, 0.25, 0.45), (2, 0.75, 0.42), (3, 0.78, 0.6), (4, 0.86, 0.6), (5, 0.88, 0.3)) AS t(k, f, size)),
c AS (SELECT ht.id, lat, lon, h, q.j, CASE WHEN q.j IN (0, 1) THEN s ELSE n END AS la, CASE WHEN q.j IN (0, 3) THEN w ELSE e END AS lo FROM ht, (VALUES (0), (1), (2), (3)) AS q(j)),
pt AS (SELECT id, j, k, f * h AS z, lat + (la - lat) * size AS la, lon + (lo - lon) * size AS lo FROM c, lv),
face AS (SELECT p.id, p.k * 4 + p.j AS face, v.i AS corner, x.la, x.lo, x.z FROM pt p, (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0)) AS v(i, up, side) JOIN pt x ON x.id = p.id AND x.k = p.k + v.up AND x.j = (p.j + v.side) % 4 WHERE p.k < 5
 UNION ALL SELECT id, 20, 3 - j, la, lo, z FROM pt WHERE k = 3
 UNION ALL SELECT p.id, 21 + p.j, v.i, x.la, x.lo, x.z FROM pt p, (VALUES (0, 0), (1, 1)) AS v(i, side) JOIN pt x ON x.id = p.id AND x.k = 5 AND x.j = (p.j + v.side) % 4 WHERE p.k = 5
 UNION ALL SELECT id, 21 + j, 2, lat, lon, h FROM c)
SELECT id, CAST(face AS INTEGER) AS face, CAST(corner AS INTEGER) AS corner, round(la, 9) AS lat, round(lo, 9) AS lon, round(z, 6) AS z FROM face""")
def fn21(spark, sf):
    """All corners of every polygon: twenty sides, the deck's floor, four sides of the spire."""
    s = O.tower_surfaces(F.slice("geometry", 1, 4), F.lit(0.0), F.col("h"))
    w = _ways(spark, sf).select("id", F.posexplode(s).alias("face", "p"))
    w = w.select("id", "face", F.posexplode("p").alias("corner", "q"))
    return w.select("id", "face", "corner", F.round("q.lat", 9).alias("lat"), F.round("q.lon", 9).alias("lon"), F.round("q.z", 6).alias("z"))


@query("fn22_prism_walls", f"""WITH {SQL_W}, c AS (SELECT id, q.k, CASE WHEN q.k IN (0, 1) THEN s ELSE n END AS la, CASE WHEN q.k IN (0, 3) THEN w ELSE e END AS lo FROM w, (VALUES (0), (1), (2), (3)) AS q(k)),
t AS (SELECT a.id, a.k, p.t, p.j, CASE WHEN p.far THEN b.la ELSE a.la END AS la, CASE WHEN p.far THEN b.lo ELSE a.lo END AS lo, p.z FROM c a JOIN c b ON b.id = a.id AND b.k = (a.k + 1) % 4,
 (VALUES (0, 0, false, 0.0::DOUBLE), (0, 1, true, 0.0), (0, 2, true, 3.0), (1, 0, false, 0.0), (1, 1, true, 3.0), (1, 2, false, 3.0)) AS p(t, j, far, z))
SELECT id, CAST(2 * k + t AS INTEGER) AS k, CAST(j AS INTEGER) AS j, round(la, 7) AS lat, round(lo, 7) AS lon, z FROM t""")
def fn22(spark, sf):
    """All corners of two triangles for every edge of a millimetre or more, counter-clockwise from above."""
    walls = O.prism_walls(F.concat("ring", F.slice("ring", 4, 1)), F.lit(0.0), F.lit(3.0))  # the last point twice: an edge without length
    w = I.ways(spark, sf).select("id", F.posexplode(walls).alias("k", "t"))
    w = w.select("id", "k", F.posexplode("t").alias("j", "p"))
    return w.select("id", "k", "j", F.round("p.lat", 7).alias("lat"), F.round("p.lon", 7).alias("lon"), F.col("p.z").alias("z"))


@query("fn23_surface_normals", f"WITH {SQL_W} SELECT id, round((n - s) * 111000.0::DOUBLE * (e - w) * 91280.04047475605::DOUBLE * 2, 3) AS size, 2 AS dropped FROM w")
def fn23(spark, sf):
    w = I.ways(spark, sf).withColumn("xyz", F.transform("ring", lambda p: F.struct(((p["lon"] - 135.4) * geo.M_LON).alias("x"), ((p["lat"] - 34.6) * geo.M_LAT).alias("y"), F.lit(5.0).alias("z"))))
    nx, ny, nz = geo.newell_normal(F.col("xyz"))
    return w.select("id", F.round(F.sqrt(nx * nx + ny * ny + nz * nz), 3).alias("size"), geo.dropped_axis(nx, ny, nz).alias("dropped"))


def _items(spark, sf):
    """Ways of buildings in grounds, and observation towers outside, with their fate, ground and mesh."""
    w = S.innermost_area(I.ways(spark, sf).withColumn("pid", F.col("id")), I.grounds(spark, sf)).drop("pid")
    tower = F.col("id") % 12 == 0
    items = written(w.filter(F.col("ground").isNotNull() | tower), "items")
    temples = I.ways(spark, sf).filter("btype = 'temple'").withColumnRenamed("id", "fid")
    known = I.buildings(spark, sf, 1200)
    return O.infill(items, temples, known).withColumns({"mesh": geo.mesh_code(F.col("lat"), F.col("lon")), "name": F.concat(F.lit("塔"), "id")})


_IT = f"""{_WIN}, it AS (SELECT w.*, ground FROM w LEFT JOIN own USING (id) WHERE ground IS NOT NULL OR id % 12 = 0),
ol AS (SELECT DISTINCT o.id FROM it o JOIN it p ON p.is_part AND NOT o.is_part AND (o.s > p.lat) <> (o.n > p.lat) AND p.lat BETWEEN o.s AND o.n AND p.lon < o.e AND NOT p.lon < o.w),
bb AS (SELECT id, (lat_u + 1200) / 1e6 AS lat, lon_u / 1e6 AS lon FROM fx_buildings),
cv AS (SELECT it.id FROM it JOIN bb ON (it.s > bb.lat) <> (it.n > bb.lat) AND bb.lon < it.e AND NOT bb.lon < it.w AND bb.lat BETWEEN it.s AND it.n
 UNION SELECT it.id FROM it JOIN w f ON f.btype = 'temple' AND (f.s > it.lat) <> (f.n > it.lat) AND it.lon < f.e AND NOT it.lon < f.w AND it.lat <= f.n),
fate AS (SELECT it.id, ground, '塔' || it.id AS name, {MESH.format("it.lat", "it.lon")} AS mesh, CASE WHEN it.id IN (SELECT id FROM ol) THEN 'outlined' WHEN it.id IN (SELECT id FROM cv) THEN 'covered' ELSE 'added' END AS fate FROM it)"""


@query("agg7_infill_statistics", f"""WITH {SQL_W}, {_IT} SELECT ground, GROUPING(ground) = 1 AS total, count(*) FILTER (WHERE fate = 'added') AS added, count(*) FILTER (WHERE fate = 'covered') AS covered, count(*) FILTER (WHERE fate = 'outlined') AS outlined,
count(DISTINCT CASE WHEN fate = 'added' THEN mesh END) AS tiles, coalesce(list_sort(list(DISTINCT name) FILTER (WHERE fate = 'added' AND ground IS NULL)), []) AS towers FROM fate GROUP BY ROLLUP (ground)""")
def agg7(spark, sf):
    return O.infill_statistics(_items(spark, sf))


@query("agg9_distinct_elements", "SELECT 'node' AS type, id, id * 3 AS seq FROM fx_landmarks UNION ALL SELECT 'node', id + 10000000, id * 3 + 1 FROM fx_peaks UNION ALL SELECT 'way', id, id * 3 + 2 FROM fx_ways")
def agg9(spark, sf):
    """Each element comes twice; the first occurrence stays."""
    e = elements(spark, sf).select("type", "id", "seq")
    return O.first_of_each(e.unionByName(e.withColumn("seq", F.col("seq") + 1_000_000_000)))


@query("agg11_element_counts", "SELECT 'node' AS type, (SELECT count(*) FROM fx_landmarks) + (SELECT count(*) FROM fx_peaks) AS n UNION ALL SELECT 'way', count(*) FROM fx_ways")
def agg11(spark, sf):
    return elements(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("set1_selector_union", f"WITH {_L}, {SQL_W} SELECT DISTINCT type, id FROM ({_LM} UNION ALL SELECT 'node', id FROM ({_SG}))")
def set1(spark, sf):
    e = elements(spark, sf)
    return O.landmarks(e, BOX).unionByName(O.sacred_grounds(e, BOX)).select("type", "id").dropDuplicates(["type", "id"])


@query("set2_index_union", "SELECT 'city' AS src, id FROM fx_buildings UNION ALL SELECT 'osm', id FROM fx_ways")
def set2(spark, sf):
    return I.buildings(spark, sf).select(F.lit("city").alias("src"), F.col("pid").alias("id")).unionByName(I.ways(spark, sf).select(F.lit("osm").alias("src"), "id"))


@query("set3_exclusions", f"WITH {SQL_W} SELECT id FROM w WHERE id NOT IN (SELECT o.id FROM w o JOIN w p ON p.is_part AND NOT o.is_part AND (o.s > p.lat) <> (o.n > p.lat) AND p.lat BETWEEN o.s AND o.n AND p.lon < o.e AND NOT p.lon < o.w)")
def set3(spark, sf):
    w = I.ways(spark, sf)
    return w.join(S.outlines_of_parts(w).select("id"), "id", "left_anti").select("id")


@query("topk1_busiest_grounds", f"WITH {SQL_W}, {_IT} SELECT ground, count(*) AS n FROM fate WHERE fate = 'added' AND ground IS NOT NULL GROUP BY ground ORDER BY n DESC, ground LIMIT 12")
def topk1(spark, sf):
    added = _items(spark, sf).filter("fate = 'added' AND ground IS NOT NULL")
    return added.groupBy("ground").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ground").limit(12)


@query("fn44_landmark_positions", f"""WITH {_L}, {SQL_W}, {SQL_B.replace("b AS", "bd AS")}, {SQL_DEM}, el AS (SELECT 'node/' || id AS qid, lat, lon, CASE WHEN is_station THEN 60 ELSE 15 END AS most FROM l),
nd AS (SELECT qid, arg_min(bd.id, ({sql_dist("el.lat", "el.lon", "bd.lat", "bd.lon")}, bd.id)) AS seq FROM el JOIN bd ON bd.lat BETWEEN el.lat - 0.001 AND el.lat + 0.001 AND bd.lon BETWEEN el.lon - 0.001 AND el.lon + 0.001
 WHERE {sql_dist("el.lat", "el.lon", "bd.lat", "bd.lon")} < most GROUP BY qid),
wb AS (SELECT 'way/' || w.id AS qid, arg_min(bd.id, (-top, bd.id)) AS seq FROM w JOIN bd ON NOT is_part AND (w.s > bd.lat) <> (w.n > bd.lat) AND bd.lon < w.e AND NOT bd.lon < w.w AND bd.lat BETWEEN w.s AND w.n GROUP BY 1),
al AS (SELECT qid, lat, lon FROM el UNION ALL SELECT 'way/' || id, CASE WHEN id % 13 = 0 THEN (s + s + n + n) / 4 ELSE (s + s + n + n + s) / 5 END, CASE WHEN id % 13 = 0 THEN (w + e + e + w) / 4 ELSE (w + e + e + w + w) / 5 END FROM w
 UNION ALL SELECT 'relation/' || id, (s + s + n + n) / 4, (w + e + e + w) / 4 FROM w WHERE id % 10 = 0),
pos AS (SELECT al.qid, coalesce(bd.lat, al.lat) AS lat, coalesce(bd.lon, al.lon) AS lon, bd.top, coalesce(bd.top - bd.base, 0) AS h FROM al LEFT JOIN (SELECT * FROM nd UNION ALL SELECT * FROM wb) m USING (qid) LEFT JOIN bd ON bd.id = m.seq)
SELECT qid, round(pos.lat, 6) AS lat, round(pos.lon, 6) AS lon, round(h, 6) AS h, floor(coalesce(top + 3, floor(dem.z / 0.1::DOUBLE + 0.5) * 0.1::DOUBLE + 8) * 10 + 0.5) / 10 AS z, CASE WHEN h <> 0 THEN floor(h + 0.5) END AS e
FROM pos JOIN dem ON dem.r = greatest(0, least(209, floor((34.78::DOUBLE - pos.lat) / 0.001::DOUBLE))) AND dem.c = greatest(0, least(239, floor((pos.lon - 135.37::DOUBLE) / 0.001::DOUBLE)))""")
def fn44(spark, sf):
    """Landmarks and ways with the building they stand on, and the label's height over it or over the ground."""
    e = all_elements(spark, sf).filter("NOT (type = 'node' AND id >= 10000000)")
    a = O.anchored_landmarks(e, I.buildings(spark, sf).select("seq", "lat", "lon", "base", "top"))
    a = H.nearest_height(a, I.heights(spark, sf))
    fields = L.anchored_fields(F.col("top"), F.col("base"), F.col("ground"))
    return a.select(F.concat_ws("/", "type", "id").alias("qid"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("h", 6).alias("h"), *[c.alias(k) for k, c in fields.items()])
