"""The derived tables in the shapes that the operators take, for Spark and as SQL snippets for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityjobs.functions import geo
from cityjobs.operators.heights import Heights, height_store
from cityjobs.operators.terrain import Grid, base_heights
from cityjobs.sources.fixtures import HEXAGON_CORNERS, fixture

GRID = Grid(north=34.78, west=135.37, res=0.001, rows=210, cols=240)
DEG = 1e6

#: SQL for the same shapes.
SQL_B = "b AS (SELECT id, lat_u / 1e6 AS lat, lon_u / 1e6 AS lon, zb_dm / 10.0::DOUBLE AS base, (zb_dm + h_dm) / 10.0::DOUBLE AS top, h_dm / 10.0::DOUBLE AS h, name, u, n_vertices FROM fx_buildings)"
SQL_E = "e AS (SELECT i, k, seq, lat1_u / 1e6 AS alat, lon1_u / 1e6 AS alon, lat2_u / 1e6 AS blat, lon2_u / 1e6 AS blon FROM fx_ground_edges)"
SQL_G = """g AS (SELECT i, abs(sum((alon * 91280.04047475605::DOUBLE) * (blat * 111000.0::DOUBLE) - (blon * 91280.04047475605::DOUBLE) * (alat * 111000.0::DOUBLE))) / 2 AS area,
  min(alat) AS s, min(alon) AS w, max(alat) AS n, max(alon) AS e FROM e GROUP BY i)"""
#: Edges crossed by the ray from (p.lat, p.lon) over edges e.
SQL_CROSS = """sum(CASE WHEN (e.alat > p.lat) <> (e.blat > p.lat) THEN CASE WHEN p.lon < (e.alon - e.blon) * (p.lat - e.blat) / (e.alat - e.blat) + e.blon THEN 1 ELSE 0 END ELSE 0 END) % 2 = 1"""
SQL_DEM = "dem AS (SELECT r, c, CASE WHEN raw = -32768 THEN 0.0::DOUBLE ELSE greatest(raw, -5)::DOUBLE END AS z FROM fx_dem)"
SQL_DIST = "sqrt((({0} - {2}) * 111000.0::DOUBLE) * (({0} - {2}) * 111000.0::DOUBLE) + (({1} - {3}) * 91280.04047475605::DOUBLE) * (({1} - {3}) * 91280.04047475605::DOUBLE))"


#: Bilinear heights (id, height) of points p (id, lat, lon) over dem.
SQL_BILINEAR = """q AS (SELECT id, lat, lon, greatest(0.0::DOUBLE, least(239.0::DOUBLE, (lon - 135.37::DOUBLE) / 0.001::DOUBLE - 0.5)) AS x, greatest(0.0::DOUBLE, least(209.0::DOUBLE, (34.78::DOUBLE - lat) / 0.001::DOUBLE - 0.5)) AS y FROM p),
f AS (SELECT *, CAST(floor(x) AS BIGINT) AS x0, CAST(floor(y) AS BIGINT) AS y0, x - floor(x) AS fx, y - floor(y) AS fy FROM q),
corner AS (SELECT id, lat, lon, unnest([y0, y0, least(209, y0 + 1), least(209, y0 + 1)]) AS r, unnest([x0, least(239, x0 + 1), x0, least(239, x0 + 1)]) AS c,
  unnest([(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy]) AS w FROM f),
bil AS (SELECT id, CASE WHEN any_value(lat) BETWEEN 34.78::DOUBLE - 210 * 0.001::DOUBLE AND 34.78::DOUBLE AND any_value(lon) BETWEEN 135.37::DOUBLE AND 135.37::DOUBLE + 240 * 0.001::DOUBLE
  THEN sum(w * dem.z) ELSE 0.0 END AS height FROM corner JOIN dem USING (r, c) GROUP BY id)"""
#: The same over an overview ov (r, c, z) of 53 x 60 cells of four times the size; names end in o.
SQL_OVERVIEW = """ov AS (SELECT r // 4 AS r, c // 4 AS c, floor(avg(z) / 0.1::DOUBLE + 0.5) * 0.1::DOUBLE AS z FROM dem GROUP BY ALL),
qo AS (SELECT id, lat, lon, greatest(0.0::DOUBLE, least(59.0::DOUBLE, (lon - 135.37::DOUBLE) / 0.004::DOUBLE - 0.5)) AS x, greatest(0.0::DOUBLE, least(52.0::DOUBLE, (34.78::DOUBLE - lat) / 0.004::DOUBLE - 0.5)) AS y FROM p),
fo AS (SELECT *, CAST(floor(x) AS BIGINT) AS x0, CAST(floor(y) AS BIGINT) AS y0, x - floor(x) AS fx, y - floor(y) AS fy FROM qo),
cornero AS (SELECT id, lat, lon, unnest([y0, y0, least(52, y0 + 1), least(52, y0 + 1)]) AS r, unnest([x0, least(59, x0 + 1), x0, least(59, x0 + 1)]) AS c,
  unnest([(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy]) AS w FROM fo),
bilo AS (SELECT id, CASE WHEN any_value(lat) BETWEEN 34.78::DOUBLE - 210 * 0.001::DOUBLE AND 34.78::DOUBLE AND any_value(lon) BETWEEN 135.37::DOUBLE AND 135.37::DOUBLE + 240 * 0.001::DOUBLE
  THEN sum(w * ov.z) ELSE 0.0 END AS height FROM cornero JOIN ov USING (r, c) GROUP BY id)"""


def sql_dist(*args: str) -> str:
    return SQL_DIST.format(*args)


def buildings(spark: SparkSession, sf_dir: str, north_u: int = 0) -> DataFrame:
    """pid = seq = id, lat, lon, base, top, h, name, u, n_vertices; ``north_u`` micro-degrees moved to the north."""
    b = fixture(spark, sf_dir, "fx_buildings")
    dm = lambda c: F.col(c) / F.lit(10.0)
    return b.select(
        F.col("id").alias("pid"), F.col("id").alias("seq"), ((F.col("lat_u") + north_u) / DEG).alias("lat"), (F.col("lon_u") / DEG).alias("lon"), dm("zb_dm").alias("base"),
        ((F.col("zb_dm") + F.col("h_dm")) / F.lit(10.0)).alias("top"), dm("h_dm").alias("h"), "name", "u", "n_vertices",
    )


def grounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, name, rel, r, lat, lon, ring (the largest), rings, area of all, s, w, n, e. Vertices are made by a rule, within the row."""
    g = fixture(spark, sf_dir, "fx_grounds")
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in HEXAGON_CORNERS])

    def hexagon(east, size):
        return F.transform(corners, lambda p: F.struct(((F.col("lat_u") + p["a"] * size) / DEG).alias("lat"), ((F.col("lon_u") + east + p["b"] * size) / DEG).alias("lon")))

    first = hexagon(F.lit(0), F.col("h10_u"))
    g = g.withColumn("rings", F.when(F.col("i") % 7 == 3, F.array(first, hexagon(30 * F.col("h10_u"), F.col("h10_u") - 35))).otherwise(F.array(first)))
    g = g.withColumns({"ring": geo.largest_ring(F.col("rings")), "area": geo.rings_area(F.col("rings"))})
    return g.select("i", "name", "rel", "r", (F.col("lat_u") / DEG).alias("lat"), (F.col("lon_u") / DEG).alias("lon"), "ring", "rings", "area", *[c.alias(k) for k, c in geo.ring_bounds(F.flatten("rings")).items()])


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lat, lon, ring (open square), box, is_part, btype, height_tag, levels_tag."""
    w = fixture(spark, sf_dir, "fx_ways")
    corner = lambda a, b: F.struct(((F.col("lat_u") + a * F.col("half_u")) / DEG).alias("lat"), ((F.col("lon_u") + b * F.col("half_u")) / DEG).alias("lon"))
    w = w.withColumn("ring", F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1)))
    return w.select("id", (F.col("lat_u") / DEG).alias("lat"), (F.col("lon_u") / DEG).alias("lon"), "ring", *[c.alias(k) for k, c in geo.ring_bounds(F.col("ring")).items()], "is_part", "btype", "height_tag", "levels_tag")


SQL_W = "w AS (SELECT id, lat_u / 1e6 AS lat, lon_u / 1e6 AS lon, (lat_u - half_u) / 1e6 AS s, (lat_u + half_u) / 1e6 AS n, (lon_u - half_u) / 1e6 AS w, (lon_u + half_u) / 1e6 AS e, is_part, btype, height_tag, levels_tag FROM fx_ways)"


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_heights(fixture(spark, sf_dir, "fx_dem"))


def heights(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None, overview: DataFrame | None = None) -> Heights:
    """The store of the grid's heights, or of other cells."""
    return height_store(dem(spark, sf_dir) if cells is None else cells, GRID, 64, overview=overview)


def tin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_tin").select((F.col("lat_u") / DEG).alias("lat"), (F.col("lon_u") / DEG).alias("lon"), (F.col("z_dm") / F.lit(10.0)).alias("z"))


def named_points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived point table with lat and lon in degrees."""
    t = fixture(spark, sf_dir, name)
    return t.withColumns({"lat": F.col("lat_u") / DEG, "lon": F.col("lon_u") / DEG}).drop("lat_u", "lon_u")
