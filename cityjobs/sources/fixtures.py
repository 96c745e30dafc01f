"""City-like tables derived from the star-schema tables, as SQL that Spark and DuckDB both run.

Coordinates are whole micro-degrees and heights whole decimetres, so that engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cityjobs.sources.shipping import ship_package

GROUNDS = """
SELECT s_suppkey AS i,
  34580000 + ((s_suppkey - CASE WHEN s_suppkey % 5 = 4 THEN 1 ELSE 0 END) * 102947) % 190000 AS lat_u,
  135380000 + ((s_suppkey - CASE WHEN s_suppkey % 5 = 4 THEN 1 ELSE 0 END) * 733103) % 220000 AS lon_u,
  CASE WHEN s_suppkey % 5 = 4 THEN 40 ELSE 90 + (s_suppkey * 37) % 110 END AS h10_u,
  CASE s_suppkey % 4 WHEN 0 THEN '金剛寺' WHEN 1 THEN '住吉神社' WHEN 2 THEN '大阪城' ELSE '天王寺教会' END || CAST(s_suppkey AS VARCHAR(20)) AS name,
  s_suppkey % 4 + 1 AS rel, s_suppkey % 3 + 1 AS r
FROM supplier"""

HEXAGON_CORNERS = ((10, 0), (5, 9), (-5, 9), (-10, 0), (-5, -9), (5, -9))
HEXAGON = "(VALUES " + ",".join(f"({i},{a},{b})" for i, (a, b) in enumerate(HEXAGON_CORNERS)) + ")"

#: Every seventh ground has a second, smaller ring (k = 1) to the east of the first.
GROUND_EDGES = f"""
SELECT g.i, g.k, o.seq, g.lat_u + o.dlat * g.h AS lat1_u, g.lon_u + o.dlon * g.h AS lon1_u, g.lat_u + p.dlat * g.h AS lat2_u, g.lon_u + p.dlon * g.h AS lon2_u
FROM (SELECT i, 0 AS k, lat_u, lon_u, h10_u AS h FROM fx_grounds UNION ALL SELECT i, 1, lat_u, lon_u + 30 * h10_u, h10_u - 35 FROM fx_grounds WHERE i % 7 = 3) g
JOIN {HEXAGON} AS o(seq, dlat, dlon) ON o.seq >= 0 JOIN {HEXAGON} AS p(seq, dlat, dlon) ON p.seq = (o.seq + 1) % 6"""

BUILDINGS = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 5 < 2 THEN g.lat_u + (o_orderkey * 7919) % 2001 - 1000 ELSE 34570000 + (o_orderkey * 2654435761) % 210000 END AS lat_u,
  CASE WHEN o_orderkey % 5 < 2 THEN g.lon_u + (o_orderkey * 104729) % 2003 - 1001 ELSE 135370000 + (o_orderkey * 40503 + 12345) % 240000 END AS lon_u,
  (o_orderkey * 31) % 400 - 20 AS zb_dm,
  20 + (o_orderkey * 53) % 600 + CASE WHEN o_orderkey % 97 = 0 THEN 1500 ELSE 0 END AS h_dm,
  CASE o_orderkey % 7 WHEN 0 THEN '411' WHEN 1 THEN '412' WHEN 2 THEN '401' WHEN 3 THEN '422' WHEN 4 THEN '461' WHEN 5 THEN '999' ELSE '' END AS u,
  CASE o_orderkey % 40 WHEN 0 THEN '北館' WHEN 1 THEN '梅田駅' WHEN 2 THEN '大阪市立中央小学校' WHEN 3 THEN '天王寺公園' WHEN 4 THEN 'グランドビル'
    WHEN 5 THEN '施設' || CAST(o_orderkey % 200 AS VARCHAR(20)) ELSE '' END AS name,
  4 + (o_orderkey * 17) % 30 AS n_vertices
FROM orders LEFT JOIN fx_grounds g ON g.i = o_orderkey % 10"""

TIN = """
SELECT 34565000 + (l_orderkey * 7907 + l_linenumber * 611 + l_partkey * 13) % 220000 AS lat_u,
  135365000 + (l_orderkey * 6301 + l_suppkey * 977 + l_partkey * 29) % 250000 AS lon_u, CAST(l_quantity AS BIGINT) * 7 - 30 AS z_dm
FROM lineitem"""

#: The grid of 210 x 240 cells; a cell's height comes from the line items that fall into it, and is missing without one.
DEM = """
SELECT CAST(floor(a.i / 240) AS BIGINT) AS r, a.i % 240 AS c, CASE WHEN q IS NULL THEN -32768 ELSE q % 60 - 10 END AS raw
FROM range(50400) AS a(i) LEFT JOIN (SELECT (l_orderkey * 7919 + l_linenumber * 10473) % 50400 AS i, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1) l ON l.i = a.i"""

WAYS = """
SELECT p_partkey AS id,
  g.lat_u + (p_partkey * 389) % 1601 - 800 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS lat_u,
  g.lon_u + (p_partkey * 577) % 1601 - 800 AS lon_u,
  CASE WHEN p_partkey % 3 = 0 THEN 40 ELSE 60 + p_size END AS half_u, p_partkey % 3 = 0 AS is_part,
  CASE p_partkey % 5 WHEN 0 THEN 'temple' WHEN 1 THEN 'shrine' WHEN 2 THEN 'gate' WHEN 3 THEN 'yes' ELSE 'pagoda' END AS btype,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS VARCHAR(20)) || ' m' WHEN p_partkey % 4 = 1 THEN CAST(p_size AS VARCHAR(20)) || ',5' ELSE NULL END AS height_tag,
  CASE WHEN p_partkey % 6 = 2 THEN CAST(p_partkey % 4 AS VARCHAR(20)) ELSE NULL END AS levels_tag
FROM part LEFT JOIN fx_grounds g ON g.i = p_partkey % 10"""

LANDMARKS = """
SELECT c_custkey AS id, 34570000 + (c_custkey * 91193) % 210000 AS lat_u, 135370000 + (c_custkey * 60493) % 240000 AS lon_u,
  CASE WHEN c_custkey % 4 = 0 THEN '駅' || CAST(c_custkey % 60 AS VARCHAR(20)) ELSE '施設' || CAST(c_custkey % 200 AS VARCHAR(20)) END AS name,
  c_custkey % 4 = 0 AS is_station, c_custkey % 6 = 1 AS notable,
  CASE WHEN c_custkey % 3 = 0 THEN 'Place ' || CAST(c_custkey % 200 AS VARCHAR(20)) ELSE NULL END AS name_en
FROM customer"""

PEAKS = """
SELECT n_nationkey AS id, 34575000 + (n_nationkey * 81239) % 200000 AS lat_u, 135375000 + (n_nationkey * 65537) % 230000 AS lon_u, n_name || '山' AS name,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(n_nationkey * 40 AS VARCHAR(20)) END AS ele_tag, n_nationkey % 2 = 0 AS wikidata
FROM nation"""

PINGS = """
SELECT event_id, user_id AS device, ts, 34570000 + (event_id * 7919) % 210000 AS lat_u, 135370000 + (event_id * 104729) % 240000 AS lon_u,
  (event_id * 37) % 360 AS alpha, (event_id * 11) % 180 - 90 AS beta, (event_id * 7) % 90 - 45 AS gamma
FROM events"""

VIEWS = """
SELECT r_regionkey AS view_id, 34600000 + r_regionkey * 30000 AS lat_u, 135400000 + r_regionkey * 35000 AS lon_u, 2200 + r_regionkey * 500 AS h_dm,
  r_regionkey * 72 AS heading, -14 AS pitch
FROM region"""

#: name -> (SQL, base tables, derived tables)
TABLES: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "fx_grounds": (GROUNDS, ("supplier",), ()),
    "fx_ground_edges": (GROUND_EDGES, (), ("fx_grounds",)),
    "fx_buildings": (BUILDINGS, ("orders",), ("fx_grounds",)),
    "fx_tin": (TIN, ("lineitem",), ()),
    "fx_dem": (DEM, ("lineitem",), ()),
    "fx_ways": (WAYS, ("part",), ("fx_grounds",)),
    "fx_landmarks": (LANDMARKS, ("customer",), ()),
    "fx_peaks": (PEAKS, ("nation",), ()),
    "fx_pings": (PINGS, ("events",), ()),
    "fx_views": (VIEWS, ("region",), ()),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the tables in ``sf_dir``."""
    ship_package(spark)
    sql, base, derived = TABLES[name]
    for t in base:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for d in derived:
        fixture(spark, sf_dir, d).createOrReplaceTempView(d)
    return spark.sql(sql)


def with_fixtures(sql: str) -> str:
    """``sql`` for DuckDB with the derived tables it names as common table expressions."""
    need: list[str] = []

    def add(name: str) -> None:
        for d in TABLES[name][2]:
            add(d)
        if name not in need:
            need.append(name)

    for name in TABLES:
        if name in sql:
            add(name)
    head = ",\n".join(f"{n} AS ({TABLES[n][0]})" for n in need)
    body = sql.strip()
    recursive = body.startswith("WITH RECURSIVE")
    rest = body.removeprefix("WITH RECURSIVE").removeprefix("WITH").strip()
    joined = f"{head},\n{rest}" if head and body.startswith("WITH") else f"{head}\n{rest}" if head else rest
    return ("WITH RECURSIVE " if recursive else "WITH ") + joined if head or body.startswith("WITH") else body
