"""Queries of the label and view operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cityjobs.functions import geo
from cityjobs.jobs import inputs as I
from cityjobs.jobs.inputs import SQL_B, SQL_BILINEAR, SQL_DEM, sql_dist
from cityjobs.jobs.registry import query
from cityjobs.operators import labels as L
from cityjobs.operators import views as V
from cityjobs.operators.heights import bilinear_height, nearest_height
from cityjobs.sources.fixtures import fixture
from cityjobs.sources.shared import written

_L = "l AS (SELECT id, lat_u / 1e6 AS lat, lon_u / 1e6 AS lon, name, is_station, notable, name_en FROM fx_landmarks)"
_NB = "nb AS (SELECT * FROM b WHERE name <> '')"
_R1 = "floor(({0}) * 10 + 0.5) / 10"


def landmarks(spark, sf):
    return I.named_points(spark, sf, "fx_landmarks")


def named(spark, sf):
    return I.buildings(spark, sf).filter("name <> ''").withColumnRenamed("pid", "id")


@query("flt8_uninformative_names", f"WITH {SQL_B} SELECT id, name FROM b WHERE name <> '' AND NOT regexp_matches(name, '^(.{{0,2}}[館棟]|.*号[館棟]|.{{1,2}}(棟|ウイング|ウィング))$')")
def flt8(spark, sf):
    return named(spark, sf).filter(~L.uninformative(F.col("name"))).select("id", "name")


@query("flt9_keep_landmarks", f"WITH {_L} SELECT id FROM l WHERE notable OR id % 90 >= 60 OR (id % 2 = 0 AND name_en IS NOT NULL)")
def flt9(spark, sf):
    l = landmarks(spark, sf)
    return l.filter(L.keep_landmark(F.col("notable"), F.col("id") % 90, F.col("id") % 2 == 0, F.col("name_en"))).select("id")


@query("flt10_keep_peaks", "SELECT id FROM fx_peaks WHERE id % 5 - 2 > 0 OR ele_tag IS NOT NULL")
def flt10(spark, sf):
    return fixture(spark, sf, "fx_peaks").filter(L.keep_peak(F.col("id") % 5 - 2, F.col("ele_tag"))).select("id")


@query("fn26_peak_fields", """WITH p AS (SELECT id, name, coalesce(nullif(TRY_CAST(ele_tag AS DOUBLE), 0), 55.5) AS ele, wikidata FROM fx_peaks)
SELECT id, floor(ele + 0.5) AS e, regexp_replace(name, '(ヶ岳|ケ岳|が岳|岳|山|峰|嶺)$', '') AS base, CAST(CASE WHEN ele >= 600 THEN 1 WHEN ele >= 250 THEN CASE WHEN wikidata THEN 1 ELSE 2 END ELSE CASE WHEN wikidata THEN 2 ELSE 3 END END AS INTEGER) AS r, 57.5::DOUBLE AS z FROM p""")
def fn26(spark, sf):
    p = fixture(spark, sf, "fx_peaks")
    return p.select("id", *[c.alias(k) for k, c in L.peak_fields(F.col("name"), F.col("ele_tag").try_cast("double"), F.lit(55.5), F.col("wikidata")).items()])


@query("fn27_ground_label_fields", f"WITH {SQL_B} SELECT id, {_R1.format('CASE WHEN id % 3 = 0 THEN 20.0::DOUBLE + 8 ELSE top + 3 END')} AS z, CASE WHEN id % 3 <> 0 AND top - base <> 0 THEN floor(top - base + 0.5) END AS e FROM b")
def fn27(spark, sf):
    b = I.buildings(spark, sf)
    top = F.when(F.col("pid") % 3 != 0, F.col("top"))
    return b.select(F.col("pid").alias("id"), *[c.alias(k) for k, c in L.anchored_fields(top, F.col("base"), F.lit(20.0)).items()])


@query("fn28_landmark_rank", f"WITH {SQL_B} SELECT id, CAST(CASE WHEN id % 4 = 0 THEN CASE WHEN id % 3 = 0 AND id % 5 <> 0 THEN 3 WHEN h >= 150 OR id % 11 = 0 THEN 2 ELSE 3 END WHEN h >= 150 OR id % 11 = 0 THEN 1 WHEN h >= 60 OR id % 3 = 0 THEN 2 ELSE 3 END AS INTEGER) AS r FROM b")
def fn28(spark, sf):
    i = F.col("pid")
    return I.buildings(spark, sf).select(i.alias("id"), L.landmark_rank(F.col("h"), i % 11 == 0, i % 3 == 0, i % 4 == 0, i % 5 != 0).alias("r"))


@query("fn29_facility_fields", f"WITH {SQL_B}, {_NB} SELECT id, CASE WHEN name LIKE '%駅' THEN 's' ELSE 'f' END AS k, CAST(CASE WHEN name LIKE '%駅' OR top - base >= 60 THEN 2 ELSE 3 END AS INTEGER) AS r, {_R1.format('top + 3')} AS z, floor(top - base + 0.5) AS e FROM nb")
def fn29(spark, sf):
    return named(spark, sf).select("id", *[c.alias(k) for k, c in L.facility_fields(F.col("name"), F.col("top"), F.col("base")).items()])


@query("fn30_clean_english", """SELECT id, CASE id % 4 WHEN 0 THEN 'Mt. X' || id WHEN 1 THEN 'Mt. Y' || id WHEN 2 THEN 'A B' || id ELSE '' END AS en FROM fx_landmarks""")
def fn30(spark, sf):
    i = F.col("id")
    raw = F.when(i % 4 == 0, F.concat(F.lit("Mt.X"), i)).when(i % 4 == 1, F.concat(F.lit("Mount Y"), i)).when(i % 4 == 2, F.concat(F.lit("A ・ B"), i)).otherwise("カナ")
    return landmarks(spark, sf).select("id", L.clean_english(raw).alias("en"))


@query("fn31_rule_translation", f"WITH {SQL_B} SELECT DISTINCT name, CASE WHEN name LIKE '%小学校%' THEN regexp_extract(name, '^(?:市立|府立|私立|国立)?(.+)小学校(.*)$', 1) ELSE name END AS part, CASE WHEN name LIKE '%小学校%' THEN ' Elementary School' ELSE '' END AS after, CASE WHEN name LIKE '%小学校%' THEN regexp_extract(name, '^(?:市立|府立|私立|国立)?(.+)小学校(.*)$', 2) ELSE '' END AS more FROM b WHERE name <> ''")
def fn31(spark, sf):
    return named(spark, sf).select("name").distinct().withColumns(L.rule_of(F.col("name")))


@query("fn32_dictionary_translation")
def fn32(spark, sf):
    """Each distinct name is translated once."""
    return L.translated(named(spark, sf))


@query("flt12_untranslated", f"WITH {SQL_B} SELECT DISTINCT name FROM b WHERE name <> '' AND (name LIKE '施設%' OR name LIKE '大阪市立中央小学校%')")
def flt12(spark, sf):
    return L.translated(named(spark, sf)).filter(F.col("en").rlike(L.JAPANESE)).select("name")


@query("fn33_station_names", f"WITH {_L} SELECT id, name || '駅' AS ja, coalesce(name_en, 'Central station') || CASE WHEN name_en IS NULL THEN '' ELSE ' Station' END AS en FROM l WHERE is_station")
def fn33(spark, sf):
    names = L.station_names(F.col("name"), F.coalesce("name_en", F.lit("Central station")))
    return landmarks(spark, sf).filter("is_station").select("id", *[c.alias(k) for k, c in names.items()])


@query("join11_english_by_name", f"""WITH {SQL_B}, {_NB}, {_L}, k AS (SELECT id AS seq, name, lat AS nlat, lon AS nlon, name_en AS en FROM l WHERE name_en IS NOT NULL),
look AS (SELECT id, lat, lon, CASE WHEN name IN (SELECT name FROM k) THEN name ELSE regexp_replace(name, '駅$', '') END AS key FROM nb)
SELECT look.id, arg_min(k.en, k.seq) AS en FROM look LEFT JOIN k ON k.name = key AND {sql_dist("lat", "lon", "nlat", "nlon")} < 5000 GROUP BY look.id""")
def join11(spark, sf):
    known = landmarks(spark, sf).filter("name_en IS NOT NULL").select("name", F.col("id").alias("seq"), F.col("lat").alias("nlat"), F.col("lon").alias("nlon"), F.col("name_en").alias("en"))
    return L.english_by_name(named(spark, sf).select("id", "name", "lat", "lon"), known, 5000.0).select("id", "en")


@query("join12_exclude_ground_names", "SELECT id FROM fx_landmarks WHERE name NOT IN (SELECT '施設' || CAST(i AS VARCHAR) FROM fx_grounds) AND id % 9 <> 0")
def join12(spark, sf):
    g = fixture(spark, sf, "fx_grounds").select(F.concat(F.lit("施設"), F.col("i").cast("string")).alias("name"))
    return landmarks(spark, sf).filter("id % 9 <> 0").join(g, "name", "left_anti").select("id")


_KN = "kn AS (SELECT CASE id % 4 WHEN 0 THEN 's' WHEN 1 THEN 'l' WHEN 2 THEN 't' ELSE 'p' END AS k, CASE id % 4 WHEN 0 THEN '梅田駅' ELSE name END AS ja, (lat_u + 2000) / 1e6 AS lat, lon_u / 1e6 AS lon FROM fx_buildings)"


@query("join13_facility_conflicts", f"""WITH {SQL_B}, {_NB}, {_KN} SELECT DISTINCT nb.id FROM nb JOIN kn ON kn.k <> 'p' AND abs(kn.lat - nb.lat) < 0.01 AND abs(kn.lon - nb.lon) < 0.01
WHERE {sql_dist("nb.lat", "nb.lon", "kn.lat", "kn.lon")} < 40 OR (nb.name = kn.ja AND ({sql_dist("nb.lat", "nb.lon", "kn.lat", "kn.lon")} < 300 OR (nb.name LIKE '%駅' AND kn.k = 's' AND {sql_dist("nb.lat", "nb.lon", "kn.lat", "kn.lon")} < 800)))""")
def join13(spark, sf):
    """Facilities against labels of all kinds made of all buildings, moved by 220 metres to the north."""
    i = F.col("pid")
    b = I.buildings(spark, sf, 2000)
    kind = F.when(i % 4 == 0, "s").when(i % 4 == 1, "l").when(i % 4 == 2, "t").otherwise("p")
    known = b.select(kind.alias("k"), F.when(i % 4 == 0, "梅田駅").otherwise(F.col("name")).alias("ja"), "lat", "lon")
    return L.beside_known_labels(named(spark, sf).select("id", "name", "lat", "lon"), known).select("id")


@query("grd2_conflict_pairs", f"""WITH {SQL_B}, {_NB} SELECT a.id AS a, b.id AS b FROM nb a JOIN nb b ON a.id < b.id AND abs(a.lat - b.lat) < 0.01 AND abs(a.lon - b.lon) < 0.01
WHERE {sql_dist("a.lat", "a.lon", "b.lat", "b.lon")} < 40 OR (a.name = b.name AND ({sql_dist("a.lat", "a.lon", "b.lat", "b.lon")} < 300 OR (a.name LIKE '%駅' AND {sql_dist("a.lat", "a.lon", "b.lat", "b.lon")} < 800)))""")
def grd2_pairs(spark, sf):
    return L.conflicts(named(spark, sf).select("id", "name", "lat", "lon"))


def _labels(spark, sf):
    """Landmarks as labels in walking order."""
    l = landmarks(spark, sf).select("id", F.col("name").alias("ja"), "lat", "lon", (F.col("id") % 3 + 1).alias("r"), F.when(F.col("id") % 4 != 0, F.col("id") % 300).alias("e"))
    key = F.struct(F.col("r"), -F.coalesce("e", F.lit(0)), F.col("id"))
    return l.withColumn("ord", F.col("r") * 1_000_000_000_000 + (1000 - F.coalesce("e", F.lit(0))) * 1_000_000_000 + F.col("id")).withColumn("key", key)


_ORD = "l2 AS (SELECT id, name AS ja, lat, lon, id % 3 + 1 AS r, CASE WHEN id % 4 <> 0 THEN id % 300 END AS e FROM l), o AS (SELECT *, row_number() OVER (PARTITION BY ja ORDER BY r, coalesce(e, 0) DESC, id) AS n FROM l2)"


@query("sort1_label_order", f"WITH {_L}, {_ORD} SELECT id, row_number() OVER (ORDER BY r, coalesce(e, 0) DESC, id) AS place FROM o")
def sort1(spark, sf):
    """All labels with their place."""
    return L.ordered_places(_labels(spark, sf), [F.col("r"), F.coalesce("e", F.lit(0)).desc(), F.col("id")]).select("id", "place")


@query("grd1_same_name_dedup", f"""WITH RECURSIVE {_L}, {_ORD},
walk(ja, n, kept) AS (SELECT ja, 0::BIGINT, CAST([] AS STRUCT(id BIGINT, lat DOUBLE, lon DOUBLE)[]) FROM o GROUP BY ja
 UNION ALL SELECT w.ja, o.n, CASE WHEN len(list_filter(w.kept, lambda k: {sql_dist("k.lat", "k.lon", "o.lat", "o.lon")} < 3000)) = 0 THEN list_append(w.kept, {{'id': o.id, 'lat': o.lat, 'lon': o.lon}}) ELSE w.kept END FROM walk w JOIN o ON o.ja = w.ja AND o.n = w.n + 1)
SELECT unnest(kept).id AS id FROM (SELECT arg_max(kept, n) AS kept FROM walk GROUP BY ja)""")
def grd1(spark, sf):
    return L.greedy_same_name(_labels(spark, sf).drop("key"), 3000.0).select("id")


@query("grd3_station_dedup", f"""WITH RECURSIVE {_L}, o AS (SELECT id, name, lat, lon, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM l WHERE is_station),
walk(name, n, lat, lon, id, took) AS (SELECT name, n, lat, lon, id, true FROM o WHERE n = 1
 UNION ALL SELECT o.name, o.n, CASE WHEN {sql_dist("w.lat", "w.lon", "o.lat", "o.lon")} < 5000 THEN w.lat ELSE o.lat END, CASE WHEN {sql_dist("w.lat", "w.lon", "o.lat", "o.lon")} < 5000 THEN w.lon ELSE o.lon END, o.id, NOT {sql_dist("w.lat", "w.lon", "o.lat", "o.lon")} < 5000
 FROM walk w JOIN o ON o.name = w.name AND o.n = w.n + 1)
SELECT id FROM walk WHERE took""")
def grd3(spark, sf):
    s = landmarks(spark, sf).filter("is_station").select("name", F.col("id").alias("seq"), "lat", "lon")
    return L.last_accepted(s, 5000.0).select(F.col("seq").alias("id"))


@query("grd2_facility_suppression", f"""WITH RECURSIVE {SQL_B}, {_NB}, c AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM nb a JOIN nb b ON a.id < b.id AND abs(a.lat - b.lat) < 0.01 AND abs(a.lon - b.lon) < 0.01
WHERE {sql_dist("a.lat", "a.lon", "b.lat", "b.lon")} < 40 OR (a.name = b.name AND ({sql_dist("a.lat", "a.lon", "b.lat", "b.lon")} < 300 OR (a.name LIKE '%駅' AND {sql_dist("a.lat", "a.lon", "b.lat", "b.lon")} < 800)))),
ins AS (SELECT b AS id, list(a) AS before FROM c GROUP BY b), num AS (SELECT id, before, row_number() OVER (ORDER BY id) AS n FROM ins),
walk(n, gone) AS (SELECT 0::BIGINT, CAST([] AS BIGINT[]) UNION ALL SELECT num.n, CASE WHEN len(list_filter(num.before, lambda x: NOT list_contains(w.gone, x))) > 0 THEN list_append(w.gone, num.id) ELSE w.gone END FROM walk w JOIN num ON num.n = w.n + 1)
SELECT id FROM nb WHERE id NOT IN (SELECT unnest(gone) FROM (SELECT arg_max(gone, n) AS gone FROM walk))""")
def grd2(spark, sf):
    return L.suppressed_facilities(named(spark, sf).select("id", "name", "lat", "lon")).select("id")


@query("agg8_label_statistics", f"""WITH {SQL_B}, {_NB}, k AS (SELECT CASE WHEN name LIKE '%駅' THEN 's' ELSE 'f' END AS k, CASE WHEN name LIKE '%駅' OR top - base >= 60 THEN 2 ELSE 3 END AS r FROM nb
 UNION ALL SELECT 'p', CASE WHEN id % 4 = 0 THEN 1 ELSE 3 END FROM fx_peaks WHERE id % 5 - 2 > 0 OR ele_tag IS NOT NULL)
SELECT k, count(*) AS n, count(*) FILTER (WHERE r = 1) AS first, CASE WHEN k = 'p' THEN (SELECT count(*) FROM fx_peaks) END AS seen FROM k GROUP BY ROLLUP (k)""")
def agg8(spark, sf):
    n = named(spark, sf).withColumns(L.facility_fields(F.col("name"), F.col("top"), F.col("base"))).select("k", "r")
    peaks = fixture(spark, sf, "fx_peaks")
    kept = peaks.filter(L.keep_peak(F.col("id") % 5 - 2, F.col("ele_tag"))).select(F.lit("p").alias("k"), F.when(F.col("id") % 4 == 0, 1).otherwise(3).alias("r"))
    return L.label_statistics(n.unionByName(kept), peaks)


@query("fn34_wikipedia_link", f"WITH {_L} SELECT id, 'https://ja.wikipedia.org/wiki/Place%20' || id AS link FROM l")
def fn34(spark, sf):
    return landmarks(spark, sf).select("id", V.wikipedia_link(F.concat(F.lit("ja:Place "), F.col("id"))).alias("link"))


@query("fn35_colour_class", f"WITH {SQL_B} SELECT id, CASE id % 5 WHEN 1 THEN '#c9874f' WHEN 2 THEN '#e2583e' WHEN 3 THEN '#b9a3d6' WHEN 4 THEN '#6fa58c' ELSE CASE WHEN name <> '' THEN '#ffe2b0' WHEN h >= 60 THEN '#dfe8f5' ELSE '#f3f0ea' END END AS colour FROM b")
def fn35(spark, sf):
    return I.buildings(spark, sf).select(F.col("pid").alias("id"), V.colour_class(F.col("pid") % 5, F.col("name"), F.col("h")).alias("colour"))


_USE = "CASE u WHEN '411' THEN 'House' WHEN '412' THEN 'Apartment' WHEN '401' THEN 'Office' WHEN '422' THEN 'Education / welfare' WHEN '461' THEN 'Unknown' ELSE '' END"


@query("join15_usage_names", f"WITH {SQL_B} SELECT id, {_USE} AS usage FROM b")
def join15(spark, sf):
    return V.usage_name(I.buildings(spark, sf)).select(F.col("pid").alias("id"), "usage")


@query("fn36_display_title", f"WITH {SQL_B} SELECT id, coalesce(nullif(name, ''), CASE WHEN id % 6 = 0 THEN 'Building at Temple' END, nullif({_USE}, ''), '—') AS title FROM b")
def fn36(spark, sf):
    b = V.usage_name(I.buildings(spark, sf))
    return b.select(F.col("pid").alias("id"), V.display_title(F.col("name"), F.when(F.col("pid") % 6 == 0, "Temple"), F.col("usage")).alias("title"))


@query("join14_ground_label", "SELECT b.id, g.i FROM (SELECT id, '大阪城' || CAST(id % 200 AS VARCHAR) AS tn FROM fx_buildings) b LEFT JOIN (SELECT name, min(i) AS i FROM fx_grounds GROUP BY name) g ON g.name = tn")
def join14(spark, sf):
    first = F.row_number().over(Window.partitionBy("name").orderBy("i"))
    g = fixture(spark, sf, "fx_grounds").withColumn("__n", first).filter("__n = 1").select(F.col("name").alias("tn"), "i")
    b = I.buildings(spark, sf).select(F.col("pid").alias("id"), F.concat(F.lit("大阪城"), (F.col("pid") % 200).cast("string")).alias("tn"))
    return b.join(g, "tn", "left").select("id", "i")


@query("fn37_heights_above_ground", f"""WITH {SQL_DEM}, {SQL_B}, g AS (SELECT b.id, top, base, floor(z / 0.1::DOUBLE + 0.5) * 0.1::DOUBLE AS ground FROM b JOIN dem ON dem.r = greatest(0, least(209, floor((34.78::DOUBLE - lat) / 0.001::DOUBLE)))
AND dem.c = greatest(0, least(239, floor((lon - 135.37::DOUBLE) / 0.001::DOUBLE)))) SELECT id, round(top - ground, 6) AS agl, round(greatest(base, ground + 1), 6) AS asl FROM g""")
def fn37(spark, sf):
    b = nearest_height(I.buildings(spark, sf), I.heights(spark, sf))
    return b.select(F.col("pid").alias("id"), F.round(F.col("top") - F.col("ground"), 6).alias("agl"), F.round(F.greatest(F.col("base"), F.col("ground") + 1), 6).alias("asl"))


@query("fn38_compass_points", "SELECT event_id, (['N','NE','E','SE','S','SW','W','NW'])[CAST(floor(alpha / 45.0 + 0.5) AS INTEGER) % 8 + 1] AS p8, (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[CAST(floor(alpha / 22.5 + 0.5) AS INTEGER) % 16 + 1] AS p16 FROM fx_pings")
def fn38(spark, sf):
    return fixture(spark, sf, "fx_pings").select("event_id", geo.compass_point(F.col("alpha"), V.POINTS_8).alias("p8"), geo.compass_point(F.col("alpha") - 360, V.POINTS_16).alias("p16"))


@query("fn39_view_links", """SELECT event_id, round(lat_u / 1e6, 6) AS lat, round(lon_u / 1e6, 6) AS lon, (event_id % 900) / 10.0::DOUBLE AS h, alpha::DOUBLE AS heading, beta::DOUBLE AS pitch, event_id % 3 = 0 AS look,
CASE WHEN event_id % 4 = 1 THEN (event_id % 7 + 1)::DOUBLE END AS spin FROM fx_pings""")
def fn39(spark, sf):
    """Views written as links and read back."""
    v = I.named_points(spark, sf, "fx_pings")
    i = F.col("event_id")
    link = V.view_link(F.col("lat"), F.col("lon"), (i % 900) / F.lit(10.0), F.col("alpha").cast("double"), F.col("beta").cast("double"), i % 3 == 0, F.when(i % 4 == 1, (i % 7 + 1).cast("double")))
    p = v.select("event_id", V.parsed_view(link).alias("v"), *[c.alias(k) for k, c in V.view_options(link).items()])
    return p.select("event_id", *[F.get("v", i).alias(n) for i, n in enumerate(("lat", "lon", "h", "heading", "pitch"))], "look", "spin")


_VEC = """t AS (SELECT event_id, device, ts, cos(radians(alpha)) AS ca, sin(radians(alpha)) AS sa, cos(radians(beta)) AS cb, sin(radians(beta)) AS sb, cos(radians(gamma)) AS cg, sin(radians(gamma)) AS sg FROM fx_pings),
v AS (SELECT event_id, device, ts, -(ca * sg + sa * sb * cg) AS dx, -(sa * sg - ca * sb * cg) AS dy, -(cb * cg) AS dz, -sa * cb AS ux, ca * cb AS uy, sb AS uz FROM t)"""


_TURNED = """t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 360 - (event_id * 13) % 360 ELSE alpha END - event_id % 3 * 10 AS al, beta, gamma, radians(event_id % 4 * 90) AS sc FROM fx_pings WHERE event_id % 7 <> 0 OR event_id % 5 = 0),
u AS (SELECT event_id, cos(radians(al)) AS ca, sin(radians(al)) AS sa, cos(radians(beta)) AS cb, sin(radians(beta)) AS sb, cos(radians(gamma)) AS cg, sin(radians(gamma)) AS sg, sin(sc) AS ss, cos(sc) AS cs FROM t),
v AS (SELECT event_id, -(ca * sg + sa * sb * cg) AS dx, -(sa * sg - ca * sb * cg) AS dy, -(cb * cg) AS dz, (ca * cg - sa * sb * sg) * ss - sa * cb * cs AS ux, (sa * cg + ca * sb * sg) * ss + ca * cb * cs AS uy, -cb * sg * ss + sb * cs AS uz FROM u)"""


@query("fn40_turned_devices", f"WITH {_TURNED} SELECT event_id, round(dx, 9) + 0 AS dx, round(dy, 9) + 0 AS dy, round(dz, 9) + 0 AS dz, round(ux, 9) + 0 AS ux, round(uy, 9) + 0 AS uy, round(uz, 9) + 0 AS uz FROM v")
def fn40_turned(spark, sf):
    """Compass headings, corrections and turned screens; events that are only relative go."""
    from cityjobs.streaming import devices as D

    i = F.col("event_id")
    p = fixture(spark, sf, "fx_pings").withColumns({"compass": F.when(i % 5 == 0, (i * 13) % 360), "absolute": i % 7 != 0, "offset": i % 3 * 10, "screen": i % 4 * 90})
    return D.vectors(p).select("event_id", *[(F.round(n, 9) + 0).alias(n) for n in ("dx", "dy", "dz", "ux", "uy", "uz")])


@query("fn40_orientation_vectors", f"WITH {_VEC} SELECT event_id, round(dx, 9) + 0 AS dx, round(dy, 9) + 0 AS dy, round(dz, 9) + 0 AS dz, round(ux, 9) + 0 AS ux, round(uy, 9) + 0 AS uy, round(uz, 9) + 0 AS uz FROM v")
def fn40(spark, sf):
    from cityjobs.streaming import devices as D

    v = D.vectors(fixture(spark, sf, "fx_pings"))
    return v.select("event_id", *[(F.round(n, 9) + 0).alias(n) for n in ("dx", "dy", "dz", "ux", "uy", "uz")])


@query("fn41_label_boxes", f"WITH {_L}, px AS (SELECT id, name, CASE id % 3 WHEN 0 THEN 17 WHEN 1 THEN 15 ELSE 13 END AS px FROM l) SELECT id, round(CASE WHEN name LIKE '駅%' THEN 1 ELSE 2 END * px + (length(name) - CASE WHEN name LIKE '駅%' THEN 1 ELSE 2 END) * px * 0.58 + 8, 6)::DOUBLE AS w, round(px * 2.4 + 6, 6)::DOUBLE AS h FROM px")
def fn41(spark, sf):
    w, h = V.label_box(F.col("name"), F.lit("l"), (F.col("id") % 3 + 1).cast("int"))
    return landmarks(spark, sf).select("id", F.round(w.cast("double"), 6).alias("w"), F.round(h.cast("double"), 6).alias("h"))


@query("fn43_offset_positions", f"WITH {_L} SELECT id, round(lat + 250 / 111320.0::DOUBLE, 9) AS lat, round(lon + 100 / (111320.0::DOUBLE * cos(radians(lat))), 9) AS lon FROM l")
def fn43(spark, sf):
    lat, lon = geo.offset_position(F.col("lat"), F.col("lon"), F.lit(250.0), F.lit(100.0))
    return landmarks(spark, sf).select("id", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("fn43_steps", f"""WITH {SQL_DEM}, s AS (SELECT id, lat_u / 1e6 AS lat0, lon_u / 1e6 AS lon0, radians(id * 7 % 360) AS h, id % 6 AS way, CASE WHEN id % 2 = 0 THEN 50.0::DOUBLE ELSE 5.0::DOUBLE END AS step, (id % 4) * 0.75::DOUBLE AS above FROM fx_landmarks),
m AS (SELECT *, CASE way WHEN 0 THEN cos(h) WHEN 1 THEN -cos(h) WHEN 2 THEN sin(h) WHEN 3 THEN -sin(h) ELSE 0.0::DOUBLE END * step AS dn, CASE way WHEN 0 THEN sin(h) WHEN 1 THEN -sin(h) WHEN 2 THEN -cos(h) WHEN 3 THEN cos(h) ELSE 0.0::DOUBLE END * step AS de,
 CASE way WHEN 4 THEN step WHEN 5 THEN -step ELSE 0.0::DOUBLE END AS du FROM s),
p AS (SELECT id, lat0 + dn / 111320.0::DOUBLE AS lat, lon0 + de / (111320.0::DOUBLE * cos(radians(lat0))) AS lon, greatest(1.0::DOUBLE, above + du) AS above FROM m), {SQL_BILINEAR}
SELECT p.id, round(p.lat, 9) AS lat, round(p.lon, 9) AS lon, round(coalesce(bil.height, 0.0::DOUBLE) + p.above, 5) AS eye FROM p LEFT JOIN bil ON bil.id = p.id""")
def fn43_steps(spark, sf):
    """A step forward, back, left, right, up or down from each landmark, and the eye over the terrain there."""
    i = F.col("id")
    way = F.get(F.array(*[F.lit(k) for k in "wsadeq"]), (i % 6).cast("int"))
    lat, lon, up = geo.step_position(F.col("lat"), F.col("lon"), i * 7 % 360, way, F.when(i % 2 == 0, 50.0).otherwise(5.0))
    moved = landmarks(spark, sf).select("id", lat.alias("lat"), lon.alias("lon"), F.greatest(F.lit(1.0), (i % 4) * 0.75 + up).alias("above"))
    out = bilinear_height(moved, I.heights(spark, sf))
    return out.select("id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), F.round(F.col("height") + F.col("above"), 5).alias("eye"))


@query("fn36_place_kinds", f"""WITH {SQL_B}, t AS (SELECT id, name, '大阪城' || (id % 50) AS tn, {_USE} AS usage FROM b), g AS (SELECT name AS ja, arg_min(rel, i) AS rel FROM fx_grounds GROUP BY name)
SELECT id, coalesce(nullif(t.name, ''), 'Building at ' || tn) AS title, CASE WHEN t.name <> '' THEN CASE g.rel WHEN 1 THEN 'Temple' WHEN 2 THEN 'Shrine' WHEN 4 THEN 'Castle' ELSE 'Place of worship' END END AS place_kind, CASE WHEN t.name <> '' THEN tn END AS place FROM t LEFT JOIN g ON ja = tn""")
def fn36_kinds(spark, sf):
    b = V.usage_name(I.buildings(spark, sf)).withColumn("tn", F.concat(F.lit("大阪城"), (F.col("pid") % 50).cast("string")))
    g = fixture(spark, sf, "fx_grounds").select(F.col("i").alias("seq"), F.lit("t").alias("k"), F.col("name").alias("ja"), F.col("rel").alias("g"))
    return V.building_rows(b, g).select(F.col("pid").alias("id"), "title", "place_kind", "place")


def _views(spark, sf):
    return I.named_points(spark, sf, "fx_views").select("view_id", F.col("lat").alias("vlat"), F.col("lon").alias("vlon"), (F.col("h_dm") / F.lit(10.0)).alias("vh"), "heading", "pitch")


def _candidates(spark, sf):
    l = landmarks(spark, sf).select("id", F.when(F.col("is_station"), "s").otherwise("l").alias("k"), (F.col("id") % 3 + 1).cast("int").alias("r"), "lat", "lon", F.lit(40.0).alias("z"))
    return V.candidates(_views(spark, sf), l)


_XYZ = "(6378137.0::DOUBLE / sqrt(1 - 0.0066943799901413165::DOUBLE * sin(radians({0})) * sin(radians({0}))) + {2}) * cos(radians({0})) * cos(radians({1})) AS x, (6378137.0::DOUBLE / sqrt(1 - 0.0066943799901413165::DOUBLE * sin(radians({0})) * sin(radians({0}))) + {2}) * cos(radians({0})) * sin(radians({1})) AS y, (6378137.0::DOUBLE / sqrt(1 - 0.0066943799901413165::DOUBLE * sin(radians({0})) * sin(radians({0}))) * (1 - 0.0066943799901413165::DOUBLE) + {2}) * sin(radians({0})) AS z"
_CAND = f"""{_L}, lx AS (SELECT id, lat, lon, is_station, id % 3 + 1 AS r, {_XYZ.format("lat", "lon", "40.0")} FROM l),
vv AS (SELECT view_id, lat_u / 1e6 AS vlat, lon_u / 1e6 AS vlon, h_dm / 10.0::DOUBLE AS vh, heading, pitch FROM fx_views), vx AS (SELECT *, {_XYZ.format("vlat", "vlon", "vh")} FROM vv),
pr AS (SELECT view_id, id, r, sqrt((lx.x - vx.x) * (lx.x - vx.x) + (lx.y - vx.y) * (lx.y - vx.y) + (lx.z - vx.z) * (lx.z - vx.z)) AS dist,
  (-sin(radians(vlon)) * (lx.x - vx.x) + cos(radians(vlon)) * (lx.y - vx.y)) * sin(radians(heading)) * cos(radians(pitch))
  + (-sin(radians(vlat)) * cos(radians(vlon)) * (lx.x - vx.x) - sin(radians(vlat)) * sin(radians(vlon)) * (lx.y - vx.y) + cos(radians(vlat)) * (lx.z - vx.z)) * cos(radians(heading)) * cos(radians(pitch))
  + (cos(radians(vlat)) * cos(radians(vlon)) * (lx.x - vx.x) + cos(radians(vlat)) * sin(radians(vlon)) * (lx.y - vx.y) + sin(radians(vlat)) * (lx.z - vx.z)) * sin(radians(pitch)) AS front,
  CASE WHEN is_station THEN CASE r WHEN 1 THEN 8000 WHEN 2 THEN 6000 ELSE 3000 END ELSE CASE r WHEN 1 THEN 45000 WHEN 2 THEN 12000 ELSE 3500 END END AS most FROM lx, vx),
cand AS (SELECT view_id, id, r, dist FROM pr WHERE dist <= most AND front > 0)"""


@query("join16_view_candidates", f"WITH {_CAND} SELECT view_id, id, round(dist, 3) AS dist FROM cand")
def join16(spark, sf):
    return _candidates(spark, sf).select("view_id", "id", F.round("dist", 3).alias("dist"))


@query("sort2_candidate_order", f"WITH {_CAND} SELECT view_id, id, row_number() OVER (PARTITION BY view_id ORDER BY r, dist, id) AS place FROM cand")
def sort2(spark, sf):
    place = F.row_number().over(Window.partitionBy("view_id").orderBy("r", "dist", "id"))
    return _candidates(spark, sf).select("view_id", "id", place.alias("place"))


@query("join17_line_of_sight")
def join17(spark, sf):
    """Candidates that no terrain hides; the terrain is raised ten times so that some is in the way."""
    pairs = _candidates(spark, sf).withColumn("pair", F.concat_ws(":", "view_id", "id"))
    high = I.dem(spark, sf).withColumn("z", F.col("z") * 10)
    high = written(high, "high-dem")
    return V.in_sight(pairs, I.heights(spark, sf, high).saved(), V.height_pyramid(high)).select("view_id", "id")


@query("grd4_label_declutter")
def grd4(spark, sf):
    """Boxes at positions scaled from the map; every seventh is hidden. At most 70 for a view."""
    c = _candidates(spark, sf).withColumn("scale", V.distance_scale(F.col("dist")))
    x, y = F.col("lon") * 4000, F.col("lat") * 4000
    c = c.select("view_id", "id", (F.col("r") * 1_000_000.0 + F.col("dist")).alias("ord"), (x - 40 * F.col("scale")).alias("x0"), (y - 30 * F.col("scale")).alias("y0"), (x + 40 * F.col("scale")).alias("x1"), y.alias("y1"), (F.col("id") % 7 != 0).alias("clear"))
    return V.declutter(c).select("view_id", "id")


@query("topk2_labels_per_view")
def topk2(spark, sf):
    return grd4(spark, sf).groupBy("view_id").agg(F.count(F.lit(1)).alias("n"))


@query("str2_orientation_smoothing", f"""WITH RECURSIVE {_VEC}, o AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) AS n FROM v),
m AS (SELECT * FROM o),
walk(device, n, event_id, dx, dy, dz, ux, uy, uz) AS (SELECT device, n, event_id, dx, dy, dz, ux, uy, uz FROM m WHERE n = 1
 UNION ALL SELECT device, n, event_id, dx / ld, dy / ld, dz / ld, ux / lu, uy / lu, uz / lu FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS ld, sqrt(ux * ux + uy * uy + uz * uz) AS lu FROM (
  SELECT m.device, m.n, m.event_id, w.dx + (m.dx - w.dx) * 0.25::DOUBLE AS dx, w.dy + (m.dy - w.dy) * 0.25::DOUBLE AS dy, w.dz + (m.dz - w.dz) * 0.25::DOUBLE AS dz, w.ux + (m.ux - w.ux) * 0.25::DOUBLE AS ux, w.uy + (m.uy - w.uy) * 0.25::DOUBLE AS uy, w.uz + (m.uz - w.uz) * 0.25::DOUBLE AS uz
  FROM walk w JOIN m ON m.device = w.device AND m.n = w.n + 1)))
SELECT event_id, round(dx, 6) + 0 AS dx, round(uy, 6) + 0 AS uy FROM walk""")
def str2(spark, sf):
    from cityjobs.streaming import devices as D

    return D.smoothed(fixture(spark, sf, "fx_pings")).select("event_id", (F.round("dx", 6) + 0).alias("dx"), (F.round("uy", 6) + 0).alias("uy"))


_P1 = "p AS (SELECT event_id AS id, lat_u / 1e6 AS lat, lon_u / 1e6 AS lon FROM fx_pings)"


@query("str1_ping_enrichment", f"""WITH {SQL_DEM}, {_P1}, {SQL_BILINEAR}, o AS (SELECT event_id, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) = 1 AS first FROM (SELECT event_id, device, ts FROM fx_pings))
SELECT event_id, round(height, 6) AS ground, round(height + 1.5, 6) AS eye, first FROM bil JOIN o ON o.event_id = bil.id""")
def str1(spark, sf):
    from cityjobs.streaming import devices as D

    out = D.first_flagged(D.enriched(I.named_points(spark, sf, "fx_pings"), I.heights(spark, sf), 1.5))
    return out.select("event_id", F.round("ground", 6).alias("ground"), F.round("eye", 6).alias("eye"), "first")


@query("str3_settled_views", """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY device ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM fx_pings),
s AS (SELECT *, sum(brk) OVER (PARTITION BY device ORDER BY ts, event_id) AS run FROM g)
SELECT device, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM s GROUP BY device, run""")
def str3(spark, sf):
    from cityjobs.streaming import devices as D

    return D.settled_views(fixture(spark, sf, "fx_pings"), "6 hours").select("device", "event_id", "n")
