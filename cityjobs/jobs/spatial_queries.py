"""Queries of geometry, of the spatial joins and of the building tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cityjobs.functions import geo
from cityjobs.jobs import inputs as I
from cityjobs.jobs.inputs import SQL_B, SQL_CROSS, SQL_E, SQL_G, SQL_W, sql_dist
from cityjobs.jobs.registry import query
from cityjobs.operators import buildings as B
from cityjobs.operators import spatial as S

SQL_IN = f"""inside AS (SELECT p.id, g.i, g.area FROM b p JOIN g ON p.lat BETWEEN g.s AND g.n AND p.lon BETWEEN g.w AND g.e JOIN e ON e.i = g.i GROUP BY p.id, g.i, g.area, e.k HAVING {SQL_CROSS}),
own AS (SELECT id, arg_min(i, (area, i)) AS ground FROM inside GROUP BY id)"""
MESH = "CAST(floor({0} * 1.5) AS BIGINT) || '' || CAST(floor({1} - 100) AS BIGINT) || CAST(floor(({0} * 1.5 - floor({0} * 1.5)) * 8) AS BIGINT) || CAST(floor(({1} - 100 - floor({1} - 100)) * 8) AS BIGINT) || CAST(floor((({0} * 1.5 - floor({0} * 1.5)) * 8 - floor(({0} * 1.5 - floor({0} * 1.5)) * 8)) * 10) AS BIGINT) || CAST(floor((({1} - 100 - floor({1} - 100)) * 8 - floor(({1} - 100 - floor({1} - 100)) * 8)) * 10) AS BIGINT)"


def classified(spark, sf):
    """Buildings with ground, cls (t: tall or in a ground) and mesh."""
    b = S.innermost_area(I.buildings(spark, sf), I.grounds(spark, sf))
    cls = F.when((F.col("h") >= 25) | F.col("ground").isNotNull(), "t").otherwise("d")
    return b.withColumns({"cls": cls, "mesh": geo.mesh_code(F.col("lat"), F.col("lon"))})


SQL_CLS = f"""{SQL_B}, {SQL_E}, {SQL_G}, {SQL_IN},
cls AS (SELECT b.*, ground, CASE WHEN h >= 25 OR ground IS NOT NULL THEN 't' ELSE 'd' END AS cls, {MESH.format("lat", "lon")} AS mesh FROM b LEFT JOIN own USING (id))"""


@query("join1_innermost_ground", f"WITH {SQL_B}, {SQL_E}, {SQL_G}, {SQL_IN} SELECT b.id, ground FROM b LEFT JOIN own USING (id)")
def join1(spark, sf):
    return S.innermost_area(I.buildings(spark, sf), I.grounds(spark, sf)).select(F.col("pid").alias("id"), "ground")


@query("fn7_tall_class", f"WITH {SQL_CLS} SELECT id, cls FROM cls")
def fn7(spark, sf):
    return classified(spark, sf).select(F.col("pid").alias("id"), "cls")


@query("fn9_mesh_code", f"WITH {SQL_B} SELECT id, {MESH.format('lat', 'lon')} AS mesh FROM b")
def fn9(spark, sf):
    return I.buildings(spark, sf).select(F.col("pid").alias("id"), geo.mesh_code(F.col("lat"), F.col("lon")).alias("mesh"))


@query("fn10_mesh_bounds", f"""WITH {SQL_B}, m AS (SELECT DISTINCT {MESH.format("lat", "lon")} AS mesh FROM b),
v AS (SELECT mesh, substr(mesh, 1, 2)::INT / 1.5::DOUBLE + substr(mesh, 5, 1)::INT / 12::DOUBLE + substr(mesh, 7, 1)::INT / 120::DOUBLE AS s, substr(mesh, 3, 2)::INT + 100 + substr(mesh, 6, 1)::INT / 8::DOUBLE + substr(mesh, 8, 1)::INT / 80::DOUBLE AS w FROM m)
SELECT mesh, round(s, 9) AS south, round(w, 9) AS west, round(s + 1 / 120::DOUBLE, 9) AS north, round(w + 1 / 80::DOUBLE, 9) AS east FROM v""")
def fn10(spark, sf):
    m = I.buildings(spark, sf).select(geo.mesh_code(F.col("lat"), F.col("lon")).alias("mesh")).distinct()
    return m.select("mesh", *[F.round(c, 9).alias(k) for k, c in geo.mesh_bounds(F.col("mesh")).items()])


_ECEF = """k AS (SELECT id, sin(radians(lat)) AS sl, cos(radians(lat)) AS cl, sin(radians(lon)) AS so, cos(radians(lon)) AS co, top FROM b),
x AS (SELECT id, (6378137.0::DOUBLE / sqrt(1 - 0.0066943799901413165::DOUBLE * sl * sl) + top) * cl * co AS x, (6378137.0::DOUBLE / sqrt(1 - 0.0066943799901413165::DOUBLE * sl * sl) + top) * cl * so AS y,
  (6378137.0::DOUBLE / sqrt(1 - 0.0066943799901413165::DOUBLE * sl * sl) * (1 - 0.0066943799901413165::DOUBLE) + top) * sl AS z FROM k)"""


@query("fn11_ecef", f"WITH {SQL_B}, {_ECEF} SELECT id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM x")
def fn11(spark, sf):
    x, y, z = geo.ecef(F.col("lat"), F.col("lon"), F.col("top"))
    return I.buildings(spark, sf).select(F.col("pid").alias("id"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(z, 4).alias("z"))


@query("fn42_ecef_to_geodetic", f"WITH {SQL_B} SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, round(top, 3) AS h FROM b")
def fn42(spark, sf):
    lat, lon, h = geo.geodetic(*geo.ecef(F.col("lat"), F.col("lon"), F.col("top")))
    return I.buildings(spark, sf).select(F.col("pid").alias("id"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), F.round(h, 3).alias("h"))


@query("fn12_point_in_ring", f"WITH {SQL_B}, {SQL_E}, {SQL_G} SELECT DISTINCT p.id, g.i FROM b p JOIN g ON p.lat BETWEEN g.s AND g.n AND p.lon BETWEEN g.w AND g.e JOIN e ON e.i = g.i GROUP BY p.id, g.i, e.k HAVING {SQL_CROSS}")
def fn12(spark, sf):
    both = S.points_in_boxes(I.buildings(spark, sf).select("pid", "lat", "lon"), I.grounds(spark, sf).select("i", "rings", "s", "w", "n", "e"), 0.005)
    return both.filter(geo.in_any_ring(F.col("lat"), F.col("lon"), F.col("rings"))).select(F.col("pid").alias("id"), "i")


@query("fn13_ring_measures", f"WITH {SQL_E}, {SQL_G} SELECT i, round(area, 3) AS area, s, w, n, e, round(avg_lat, 9) AS mean_lat, round(avg_lon, 9) AS mean_lon FROM g JOIN (SELECT i, avg(alat) AS avg_lat, avg(alon) AS avg_lon FROM e WHERE k = 0 GROUP BY i) USING (i)")
def fn13(spark, sf):
    g = I.grounds(spark, sf)
    return g.select("i", F.round("area", 3).alias("area"), "s", "w", "n", "e", F.round(geo.ring_mean(F.col("ring"), "lat"), 9).alias("mean_lat"), F.round(geo.ring_mean(F.col("ring"), "lon"), 9).alias("mean_lon"))


_BIDX = "nb AS (SELECT q.id AS qid, b.id AS seq, {dist} AS dist FROM q JOIN b ON abs(b.lat - q.lat) < 0.001::DOUBLE AND abs(b.lon - q.lon) < 0.001::DOUBLE)"


@query("join2_nearest_building", f"""WITH {SQL_B}, q AS (SELECT id, lat_u / 1e6 AS lat, lon_u / 1e6 AS lon FROM fx_landmarks), nb AS (SELECT q.id AS qid, b.id AS seq, {sql_dist("q.lat", "q.lon", "b.lat", "b.lon")} AS dist
  FROM q JOIN b ON b.lat BETWEEN q.lat - 0.001 AND q.lat + 0.001 AND b.lon BETWEEN q.lon - 0.001 AND q.lon + 0.001),
best AS (SELECT qid, arg_min(seq, (dist, seq)) AS nearest, min(dist) AS dist FROM nb WHERE dist < 60 GROUP BY qid)
SELECT q.id, nearest, round(dist, 6) AS dist FROM q LEFT JOIN best ON qid = q.id""")
def join2(spark, sf):
    q = I.named_points(spark, sf, "fx_landmarks").select(F.col("id").alias("qid"), "lat", "lon")
    return S.nearest_within(q, I.buildings(spark, sf), 60.0).select(F.col("qid").alias("id"), "nearest", F.round("dist", 6).alias("dist"))


@query("join3_tallest_in_polygon", f"""WITH {SQL_B}, {SQL_E}, {SQL_G}, inside AS (SELECT p.id, g.i, p.top FROM b p JOIN g ON p.lat BETWEEN g.s AND g.n AND p.lon BETWEEN g.w AND g.e JOIN e ON e.i = g.i GROUP BY p.id, g.i, p.top, e.k HAVING {SQL_CROSS}),
best AS (SELECT i, arg_min(id, (-top, id)) AS tallest FROM inside GROUP BY i) SELECT g.i, tallest FROM g LEFT JOIN best USING (i)""")
def join3(spark, sf):
    return S.tallest_inside(I.grounds(spark, sf), I.buildings(spark, sf)).select("i", "tallest")


@query("join4_not_covered", f"""WITH {SQL_B}, {SQL_W}, hit AS (SELECT w.id FROM w JOIN b ON b.lat BETWEEN w.s AND w.n AND b.lon BETWEEN w.w AND w.e
  WHERE (w.s > b.lat) <> (w.n > b.lat) AND b.lon < w.e AND NOT b.lon < w.w)
SELECT id FROM w WHERE id NOT IN (SELECT id FROM hit) AND NOT EXISTS (SELECT 1 FROM w f WHERE f.btype = 'temple' AND (f.s > w.lat) <> (f.n > w.lat) AND w.lon < f.e AND NOT w.lon < f.w AND w.lat <= f.n)""")
def join4(spark, sf):
    w = I.ways(spark, sf)
    return S.not_covered(w, w.filter("btype = 'temple'").withColumnRenamed("id", "fid"), I.buildings(spark, sf)).select("id")


@query("join5_outline_by_parts", f"WITH {SQL_W} SELECT DISTINCT o.id FROM w o JOIN w p ON p.is_part AND NOT o.is_part AND p.id <> o.id AND (o.s > p.lat) <> (o.n > p.lat) AND p.lat BETWEEN o.s AND o.n AND p.lon < o.e AND NOT p.lon < o.w")
def join5(spark, sf):
    return S.outlines_of_parts(I.ways(spark, sf)).select("id")


@query("win1_batch_id", f"WITH {SQL_CLS} SELECT id, mesh, cls, row_number() OVER (PARTITION BY mesh, cls ORDER BY id) - 1 AS batch_id FROM cls")
def win1(spark, sf):
    n = F.row_number().over(Window.partitionBy("mesh", "cls").orderBy("seq")) - 1
    return classified(spark, sf).select(F.col("pid").alias("id"), "mesh", "cls", n.cast("long").alias("batch_id"))


@query("agg5_tile_bounds", f"WITH {SQL_CLS} SELECT mesh, cls, round(radians(min(lon)), 12) AS w, round(radians(min(lat)), 12) AS s, round(radians(max(lon)), 12) AS e, round(radians(max(lat)), 12) AS n, min(base) AS lo, max(top) AS hi FROM cls GROUP BY ROLLUP (mesh, cls)")
def agg5(spark, sf):
    rad = lambda c: F.round(F.radians(c), 12)
    t = classified(spark, sf).rollup("mesh", "cls")
    return t.agg(rad(F.min("lon")).alias("w"), rad(F.min("lat")).alias("s"), rad(F.max("lon")).alias("e"), rad(F.max("lat")).alias("n"), F.min("base").alias("lo"), F.max("top").alias("hi"))


@query("agg6_build_statistics", f"""WITH {SQL_CLS}, one AS (SELECT *, id % 17 = 0 AS skipped, ground IS NOT NULL AND id % 5 = 0 AS lod2, floor((34.78::DOUBLE - lat) / 0.001::DOUBLE) * 240 + floor((lon - 135.37::DOUBLE) / 0.001::DOUBLE) AS cell FROM cls)
SELECT mesh, count(*) FILTER (WHERE NOT skipped) AS n, count(*) FILTER (WHERE skipped) AS skipped, count(ground) FILTER (WHERE NOT skipped) AS in_grounds, count(*) FILTER (WHERE lod2 AND NOT skipped) AS lod2,
  count(DISTINCT CASE WHEN NOT skipped THEN mesh || cls END) AS tiles, count(*) FILTER (WHERE name <> '' AND NOT skipped) AS named, count(DISTINCT CASE WHEN NOT skipped THEN cell END) AS cells FROM one GROUP BY ROLLUP (mesh)""")
def agg6(spark, sf):
    """Every seventeenth building has no valid solid; every fifth in a ground has surfaces."""
    cell = geo.grid_cell(F.col("lat"), F.col("lon"), I.GRID.north, I.GRID.west, I.GRID.res, I.GRID.cols)[2]
    b = classified(spark, sf).withColumns({"valid": F.col("pid") % 17 != 0, "lod2": F.col("ground").isNotNull() & (F.col("pid") % 5 == 0), "cell": cell})
    return B.statistics(b)


@query("flt4_ways_in_grounds", f"""WITH {SQL_W}, b AS (SELECT id, lat, lon FROM w), {SQL_E}, {SQL_G} SELECT DISTINCT id FROM (SELECT DISTINCT p.id, g.i FROM b p JOIN g ON p.lat BETWEEN g.s AND g.n AND p.lon BETWEEN g.w AND g.e JOIN e ON e.i = g.i GROUP BY p.id, g.i, e.k HAVING {SQL_CROSS})""")
def flt4(spark, sf):
    w = I.ways(spark, sf).select(F.col("id").alias("pid"), "lat", "lon")
    return S.innermost_area(w, I.grounds(spark, sf)).filter("ground IS NOT NULL").select(F.col("pid").alias("id"))


@query("fn24_quantized_positions", f"""WITH {SQL_B}, q AS (SELECT id, floor(h / 0.05::DOUBLE + 0.5) AS qx, floor(top / 0.05::DOUBLE + 0.5) AS qy, floor(-base / 0.05::DOUBLE + 0.5) AS qz FROM b)
SELECT id, CAST(qx AS INTEGER) AS qx, CAST(qy AS INTEGER) AS qy, CAST(qz AS INTEGER) AS qz FROM q""")
def fn24(spark, sf):
    q = geo.quantized_position(F.col("h"), F.col("base"), F.col("top"))
    return I.buildings(spark, sf).select(F.col("pid").alias("id"), q.alias("q")).select("id", *[F.get("q", i).alias(f"q{a}") for i, a in enumerate("xyz")])


@query("fn5_base_and_top", f"WITH {SQL_B} SELECT id, base AS zb, top AS zt FROM b")
def fn5(spark, sf):
    b = I.buildings(spark, sf).withColumn("solids", F.array(F.struct((F.col("base") + 1).alias("zb"), F.col("top").alias("zt")), F.struct(F.col("base").alias("zb"), (F.col("top") - 1).alias("zt"))))
    return b.select(F.col("pid").alias("id"), F.array_min(F.transform("solids", lambda s: s["zb"])).alias("zb"), F.array_max(F.transform("solids", lambda s: s["zt"])).alias("zt"))
