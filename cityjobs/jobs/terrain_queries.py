"""Queries of the terrain operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityjobs.functions import geo
from cityjobs.jobs import inputs as I
from cityjobs.jobs.inputs import GRID, SQL_B, SQL_BILINEAR, SQL_DEM, SQL_OVERVIEW
from cityjobs.jobs.registry import query
from cityjobs.operators import heights as H
from cityjobs.operators import terrain as T
from cityjobs.sources.shared import written

_TIN = """tin AS (SELECT CAST(floor((34.78::DOUBLE - lat_u / 1e6) / 0.001::DOUBLE) AS BIGINT) AS r, CAST(floor((lon_u / 1e6 - 135.37::DOUBLE) / 0.001::DOUBLE) AS BIGINT) AS c, z_dm / 10.0::DOUBLE AS z FROM fx_tin),
means AS (SELECT r, c, avg(z) AS z, count(*) AS n FROM tin WHERE r BETWEEN 0 AND 209 AND c BETWEEN 0 AND 239 GROUP BY r, c)"""
_SAMPLES = """samples AS (SELECT CAST(floor((34.78::DOUBLE - lat) / 0.001::DOUBLE) AS BIGINT) AS r, CAST(floor((lon - 135.37::DOUBLE) / 0.001::DOUBLE) AS BIGINT) AS c, base FROM b),
med AS (SELECT r, c, list_sort(list(base))[count(*) // 2 + 1] AS median, count(*) AS n FROM samples GROUP BY r, c)"""


@query("src3_base_dem", f"WITH {SQL_DEM} SELECT r, c, z FROM dem")
def src3(spark, sf):
    return I.dem(spark, sf)


@query("agg1_tin_mean", f"WITH {_TIN} SELECT r, c, round(z, 6) AS z, n FROM means")
def agg1(spark, sf):
    return T.mean_of_vertices(I.tin(spark, sf), GRID).select("r", "c", F.round("z", 6).alias("z"), "n")


@query("fn8_dem_cell", f"WITH {SQL_B} SELECT id, CAST(floor((34.78::DOUBLE - lat) / 0.001::DOUBLE) AS BIGINT) AS r, CAST(floor((lon - 135.37::DOUBLE) / 0.001::DOUBLE) AS BIGINT) AS c, CAST(floor((34.78::DOUBLE - lat) / 0.001::DOUBLE) * 240 + floor((lon - 135.37::DOUBLE) / 0.001::DOUBLE) AS BIGINT) AS cell FROM b")
def fn8(spark, sf):
    row, col, cell = geo.grid_cell(F.col("lat"), F.col("lon"), GRID.north, GRID.west, GRID.res, GRID.cols)
    return I.buildings(spark, sf).select(F.col("pid").alias("id"), row.alias("r"), col.alias("c"), cell.alias("cell"))


def _samples(spark, sf):
    return I.buildings(spark, sf).select(GRID.row(F.col("lat")).alias("r"), GRID.col(F.col("lon")).alias("c"), F.col("base"))


@query("agg2_upper_median", f"WITH {SQL_B}, {_SAMPLES} SELECT r, c, median, n FROM med")
def agg2(spark, sf):
    return T.upper_median(_samples(spark, sf), ["r", "c"], "base")


@query("snk6_ground_samples", f"WITH {SQL_B}, {_SAMPLES} SELECT r * 240 + c AS cell, floor(median * 100 + 0.5) / 100 AS z FROM med WHERE r BETWEEN 0 AND 209 AND c BETWEEN 0 AND 239")
def snk6(spark, sf):
    m = T.upper_median(_samples(spark, sf), ["r", "c"], "base").filter(F.col("r").between(0, 209) & F.col("c").between(0, 239))
    return m.select((F.col("r") * 240 + F.col("c")).alias("cell"), geo.round_half_up(F.col("median"), 2).alias("z"))


_FIX = f"""{SQL_DEM}, {SQL_B}, {_SAMPLES},
diff AS (SELECT med.r, med.c, median - dem.z AS d FROM med JOIN dem USING (r, c)),
full_d AS (SELECT dem.r, dem.c, dem.z, coalesce(d, 0.0) AS d, CASE WHEN d IS NULL THEN 0 ELSE 1 END AS k FROM dem LEFT JOIN diff USING (r, c)),
r1 AS (SELECT r, c, z, sum(d) OVER w AS d, sum(k) OVER w AS k FROM full_d WINDOW w AS (PARTITION BY r ORDER BY c RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
c1 AS (SELECT r, c, z, sum(d) OVER w AS d, sum(k) OVER w AS k FROM r1 WINDOW w AS (PARTITION BY c ORDER BY r RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
r2 AS (SELECT r, c, z, sum(d) OVER w AS d, sum(k) OVER w AS k FROM c1 WINDOW w AS (PARTITION BY r ORDER BY c RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
c2 AS (SELECT r, c, z, sum(d) OVER w AS d, sum(k) OVER w AS k FROM r2 WINDOW w AS (PARTITION BY c ORDER BY r RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
fixed AS (SELECT r, c, CASE WHEN k > 0 THEN d / k * least(1.0::DOUBLE, k / 20.0::DOUBLE) ELSE 0.0 END AS delta, z FROM c2)"""


def _corrected(spark, sf):
    med = T.upper_median(_samples(spark, sf), ["r", "c"], "base").select("r", "c", F.col("median").alias("s"))
    return T.corrected(I.dem(spark, sf), med, GRID)


@query("agg3_residual_smoothing", f"WITH {_FIX} SELECT r, c, round(z + delta + 1e-9, 4) AS z FROM fixed")
def agg3(spark, sf):
    return _corrected(spark, sf).select("r", "c", F.round(F.col("z") + 1e-9, 4).alias("z"))


@query("agg3_correction_report", f"WITH {_FIX} SELECT count(*) FILTER (WHERE abs(delta) > 1e-9) AS n, round(avg(abs(delta)) FILTER (WHERE abs(delta) > 1e-9), 6) AS mean_abs FROM fixed")
def agg3r(spark, sf):
    moved = F.abs("delta") > 1e-9
    return _corrected(spark, sf).agg(F.count_if(moved).alias("n"), F.round(F.avg(F.when(moved, F.abs("delta"))), 6).alias("mean_abs"))


@query("win2_sliding_box_sum", f"""WITH {SQL_DEM}, a AS (SELECT r, c, sum(z) OVER (PARTITION BY r ORDER BY c RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM dem)
SELECT r, c, sum(s) OVER (PARTITION BY c ORDER BY r RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS z FROM a""")
def win2(spark, sf):
    return T.box_sum(I.dem(spark, sf), "z")


@query("join10_terrain_override", f"WITH {SQL_DEM}, {_TIN} SELECT r, c, round(coalesce(means.z, dem.z), 6) AS z, means.z IS NOT NULL AS overridden FROM dem LEFT JOIN means USING (r, c)")
def join10(spark, sf):
    return T.overridden(I.dem(spark, sf), T.mean_of_vertices(I.tin(spark, sf), GRID)).withColumn("z", F.round("z", 6))


@query("agg10_terrain_coverage", f"WITH {SQL_DEM}, {_TIN} SELECT count(*) AS cells, count(means.z) AS overridden FROM dem LEFT JOIN means USING (r, c)")
def agg10(spark, sf):
    return T.coverage(I.dem(spark, sf), T.mean_of_vertices(I.tin(spark, sf), GRID))


@query("agg4_overview", f"WITH {SQL_DEM} SELECT r // 4 AS r, c // 4 AS c, CAST(floor(avg(z) / 0.1::DOUBLE + 0.5) AS INTEGER) AS z_dm FROM dem GROUP BY ALL")
def agg4(spark, sf):
    return T.overview(I.dem(spark, sf))


@query("fn25_height_quantization", f"WITH {SQL_DEM} SELECT r, c, CAST(greatest(-32767, least(32767, floor(z * 1.5 / 0.1::DOUBLE + 0.5))) AS INTEGER) AS z_dm FROM dem")
def fn25(spark, sf):
    return I.dem(spark, sf).select("r", "c", geo.clamped_steps(F.col("z") * 1.5, 0.1).alias("z_dm"))


@query("snk3_terrain_chunks", f"""WITH {SQL_DEM}, ch AS (SELECT cr, cc, y, x, least(cr * 64 + y, 209) AS r, least(cc * 64 + x, 239) AS c
FROM range(4) a(cr), range(4) b(cc), range(65) d(y), range(65) f(x))
SELECT cr, cc, y, x, CAST(floor(z / 0.1::DOUBLE + 0.5) AS INTEGER) AS z_dm FROM ch JOIN dem USING (r, c)""")
def snk3(spark, sf):
    return T.chunked(I.dem(spark, sf), GRID, 64)


_P = "p AS (SELECT id, lat_u / 1e6 AS lat, lon_u / 1e6 AS lon FROM fx_landmarks)"
_NEAR = """near AS (SELECT p.id, dem.r, dem.c, floor(z / 0.1::DOUBLE + 0.5) * 0.1::DOUBLE AS ground FROM p JOIN dem ON dem.r = greatest(0, least(209, floor((34.78::DOUBLE - lat) / 0.001::DOUBLE)))
AND dem.c = greatest(0, least(239, floor((lon - 135.37::DOUBLE) / 0.001::DOUBLE))))"""


@query("join6_nearest_terrain", f"WITH {SQL_DEM}, {_P}, {_NEAR} SELECT id, round(ground, 6) AS ground FROM near")
def join6(spark, sf):
    return H.nearest_height(I.named_points(spark, sf, "fx_landmarks"), I.heights(spark, sf)).select("id", F.round("ground", 6).alias("ground"))


@query("join7_bilinear_terrain", f"""WITH {SQL_DEM}, {_P}, {SQL_BILINEAR}, {SQL_OVERVIEW}, whole AS (SELECT id FROM corner WHERE r >= 40 OR c >= 40 GROUP BY id HAVING count(*) = 4)
SELECT p.id, round(CASE WHEN p.id IN (SELECT id FROM whole) THEN bil.height ELSE bilo.height END, 6) AS height FROM p LEFT JOIN bil USING (id) LEFT JOIN bilo USING (id)""")
def join7(spark, sf):
    """The full cells of the north-west corner are not there: the overview steps in."""
    dem = written(I.dem(spark, sf), "dem")
    store = I.heights(spark, sf, dem.filter("r >= 40 OR c >= 40"), T.overview(dem))
    return H.bilinear_with_fallback(I.named_points(spark, sf, "fx_landmarks"), store).select("id", F.round("height", 6).alias("height"))


@query("flt11_inside_grid", f"WITH {_P} SELECT id FROM p WHERE lat BETWEEN 34.6::DOUBLE - 100 * 0.001::DOUBLE AND 34.6::DOUBLE AND lon BETWEEN 135.4::DOUBLE AND 135.4::DOUBLE + 100 * 0.001::DOUBLE")
def flt11(spark, sf):
    part = T.Grid(34.6, 135.4, 0.001, 100, 100)
    return I.named_points(spark, sf, "fx_landmarks").filter(part.has(F.col("lat"), F.col("lon"))).select("id")


@query("join8_local_maximum", f"""WITH {SQL_DEM}, p AS (SELECT id, CAST(floor((34.78::DOUBLE - lat_u / 1e6) / 0.001::DOUBLE) AS BIGINT) AS r0, CAST(floor((lon_u / 1e6 - 135.37::DOUBLE) / 0.001::DOUBLE) AS BIGINT) AS c0 FROM fx_peaks)
SELECT id, r AS hr, c AS hc, z AS hz FROM (SELECT id, r, c, z, row_number() OVER (PARTITION BY id ORDER BY z DESC, r, c) AS n FROM p JOIN dem ON r BETWEEN r0 - 2 AND r0 + 2 AND c BETWEEN c0 - 2 AND c0 + 2) WHERE n = 1""")
def join8(spark, sf):
    return H.highest_around(I.named_points(spark, sf, "fx_peaks"), I.heights(spark, sf)).select("id", "hr", "hc", "hz")


@query("join9_lowest_under_footprint", f"""WITH {SQL_DEM}, {I.SQL_W}, p AS (SELECT id, unnest([s, s, n, n]) AS lat, unnest([w, e, e, w]) AS lon FROM w), {_NEAR} SELECT id, round(min(ground), 6) AS ground FROM near GROUP BY id""")
def join9(spark, sf):
    return H.lowest_under(I.ways(spark, sf), I.heights(spark, sf), "id").select("id", F.round("ground", 6).alias("ground"))


_TILES = """t AS (SELECT DISTINCT level, CAST(floor((lon_u / 1e6 + 180) / (180.0::DOUBLE / (1 << level))) AS BIGINT) AS x, CAST(floor((90 - lat_u / 1e6) / (180.0::DOUBLE / (1 << level))) AS BIGINT) AS y
FROM fx_buildings, (VALUES (9), (11)) AS l(level)), p AS (SELECT ((level * 65536 + x) * 65536 + y) * 10000 + j * 100 + i AS id, level, x, y, j, i, 90 - y * (180.0::DOUBLE / (1 << level)) - j * (180.0::DOUBLE / (1 << level) / 32) AS lat,
 -180 + x * (180.0::DOUBLE / (1 << level)) + i * (180.0::DOUBLE / (1 << level) / 32) AS lon FROM t, range(33) a(j), range(33) b(i))"""


@query("join18_terrain_tiles", f"""WITH {SQL_DEM}, {_TILES}, {SQL_BILINEAR}, {SQL_OVERVIEW}
SELECT p.level, p.x, p.y, list(round(CASE WHEN level = 9 THEN bilo.height ELSE bil.height END, 6) ORDER BY j, i) AS heights FROM p JOIN bil USING (id) JOIN bilo USING (id) GROUP BY p.level, p.x, p.y""")
def join18(spark, sf):
    """Tiles of two levels: the samples of one are further apart than four cells, so they come from the overview."""
    b = I.buildings(spark, sf).withColumn("level", F.explode(F.array(F.lit(9), F.lit(11))))
    size = 180.0 / F.pow(F.lit(2.0), F.col("level"))
    tiles = b.select("level", F.floor((F.col("lon") + 180) / size).alias("x"), F.floor((90 - F.col("lat")) / size).alias("y")).distinct()
    s = T.tile_samples(tiles).withColumn("id", ((F.col("level") * 65536 + F.col("x")) * 65536 + F.col("y")) * 10000 + F.col("j") * 100 + F.col("i"))
    dem = written(I.dem(spark, sf), "dem")
    h = H.bilinear_with_fallback(s, I.heights(spark, sf, dem, T.overview(dem)), use_full=F.col("step") <= GRID.res * 4)
    rows = F.array_sort(F.collect_list(F.struct("j", "i", F.round("height", 6).alias("h"))))  # 33 x 33 for each tile
    return h.groupBy("level", "x", "y").agg(F.transform(rows, lambda v: v["h"]).alias("heights"))
