"""Queries of the products from end to end, over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityjobs.functions import geo
from cityjobs.jobs import inputs as I
from cityjobs.jobs.osm_queries import _GR, _H, _WIN, all_elements, elements
from cityjobs.jobs.registry import query
from cityjobs.jobs.spatial_queries import MESH, SQL_CLS
from cityjobs.jobs.terrain_queries import _FIX, _TIN
from cityjobs.plans import city


@query("job_buildings", f"WITH {SQL_CLS} SELECT id, mesh, cls, ground, row_number() OVER (PARTITION BY mesh, cls ORDER BY id) - 1 AS batch_id, CAST(floor((34.78::DOUBLE - lat) / 0.001::DOUBLE) * 240 + floor((lon - 135.37::DOUBLE) / 0.001::DOUBLE) AS BIGINT) AS cell FROM (SELECT * REPLACE (CASE WHEN top - base >= 25 OR ground IS NOT NULL THEN 't' ELSE 'd' END AS cls) FROM cls)")
def job_buildings(spark, sf):
    return city.building_table(I.buildings(spark, sf), I.grounds(spark, sf), I.GRID).select(F.col("pid").alias("id"), "mesh", "cls", "ground", "batch_id", "cell")


@query("job_terrain", f"WITH {_FIX}, {_TIN} SELECT fixed.r, fixed.c, round(coalesce(means.z, fixed.z + delta) + 1e-9, 4) AS z FROM fixed LEFT JOIN means ON means.r = fixed.r AND means.c = fixed.c")
def job_terrain(spark, sf):
    bases = I.buildings(spark, sf).select(I.GRID.row(F.col("lat")).alias("r"), I.GRID.col(F.col("lon")).alias("c"), "base")
    return city.terrain_cells(I.dem(spark, sf), bases, I.tin(spark, sf), I.GRID).select("r", "c", F.round(F.col("z") + 1e-9, 4).alias("z"))


def _ways(spark, sf):
    box = geo.ring_bounds(F.col("geometry"))
    return elements(spark, sf).filter("type = 'way' AND id % 13 <> 0").withColumns(box)


@query("job_infill", f"""WITH {I.SQL_DEM}, {I.SQL_W.replace("w AS", "w0 AS")}, w AS (SELECT * FROM w0 WHERE id % 13 <> 0), {_H}, {_WIN}, {_GR},
it AS (SELECT ht.*, own.ground AS area FROM ht LEFT JOIN own USING (id) WHERE own.ground IS NOT NULL OR ((id % 12 = 0 OR id % 20 = 13) AND NOT is_part AND th >= 30)),
ol AS (SELECT DISTINCT o.id FROM it o JOIN it p ON p.is_part AND NOT o.is_part AND (o.s > p.lat) <> (o.n > p.lat) AND p.lat BETWEEN o.s AND o.n AND p.lon BETWEEN o.w AND o.e AND p.lon < o.e AND NOT p.lon < o.w),
bb AS (SELECT (lat_u + 1200) / 1e6 AS lat, lon_u / 1e6 AS lon FROM fx_buildings),
cv AS (SELECT it.id FROM it JOIN bb ON (it.s > bb.lat) <> (it.n > bb.lat) AND bb.lon < it.e AND NOT bb.lon < it.w AND bb.lat BETWEEN it.s AND it.n
 UNION SELECT it.id FROM it JOIN w0 f ON f.btype = 'temple' AND (f.s > it.lat) <> (f.n > it.lat) AND it.lon < f.e AND NOT it.lon < f.w AND it.lat BETWEEN f.s AND f.n)
SELECT it.id, area, {MESH.format("it.lat", "it.lon")} AS mesh, round(gr.ground, 6) AS ground, round(gr.ground + min_h, 6) AS base, round(gr.ground + h, 6) AS top,
 CAST(CASE WHEN area IS NULL THEN 25 WHEN rh > 0.3 AND shape <> 'flat' THEN 8 ELSE 5 END AS INTEGER) AS surfaces
FROM it JOIN gr ON gr.id = it.id WHERE it.id NOT IN (SELECT id FROM ol) AND it.id NOT IN (SELECT id FROM cv)""")
def job_infill(spark, sf):
    """Every thirteenth way is open and no item; known are the temples' footprints, and the buildings moved to the north."""
    temples = I.ways(spark, sf).filter("btype = 'temple'").withColumnRenamed("id", "fid")
    out = city.infill_table(_ways(spark, sf), I.grounds(spark, sf), temples, I.buildings(spark, sf, 1200), I.heights(spark, sf).saved())
    six = lambda c: F.round(c, 6).alias(c)
    return out.select("id", "area", "mesh", six("ground"), six("base"), six("top"), F.size("surfaces").alias("surfaces"))


def _grounds(spark, sf):
    """Every eleventh ground has no rings, some have English names and articles."""
    i = F.col("i")
    g = I.grounds(spark, sf)
    return g.withColumns({
        "rings": F.when(i % 11 == 5, F.slice("rings", 1, 0)).otherwise(F.col("rings")), "en": F.when(i % 3 == 0, F.concat(F.lit("Ground・"), i)).when(i % 3 == 1, "ひらがな"),
        "wikipedia": F.when(i % 4 == 0, F.concat(F.lit("ja:"), F.col("name"))).when(i % 4 == 1, ""),
    })


@query("job_labels")
def job_labels(spark, sf):
    """Peaks, grounds, landmarks and stations, and named buildings."""
    peaks = I.named_points(spark, sf, "fx_peaks").select(F.col("id").alias("seq"), "name", "lat", "lon", F.col("ele_tag").alias("ele"), "wikidata")
    named = all_elements(spark, sf).filter("id < 10000000 AND tags['name'] IS NOT NULL")
    b = I.buildings(spark, sf)
    return city.label_table(peaks, _grounds(spark, sf), named, b.filter("name <> ''").select("seq", "name", "lat", "lon", "base", "top"), b.select("seq", "lat", "lon", "base", "top"), I.heights(spark, sf).saved())
