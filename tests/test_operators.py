"""Operators against plain Python on small inputs."""

import json
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cityjobs.functions import geo
from cityjobs.operators import buildings, greedy, heights, labels, osm, spatial, terrain, views
from cityjobs.operators.terrain import Grid
from cityjobs.plans import city
from cityjobs.sources import readers, writers
from cityjobs.streaming import devices


def test_ring_assembly_turns_pieces_and_keeps_open_rings():
    a, b, c, d = (0, 0), (0, 1), (1, 1), (1, 0)
    assert osm.join_segments([[a, b, c], [a, d, c]]) == [[a, b, c, d, a]]
    assert osm.join_segments([[a, b], [(5, 5), (6, 6)]]) == []
    assert osm.join_segments([[a, b, c, d]]) == [[a, b, c, d]]


def test_simplification_keeps_three_vertices():
    keep = osm.simplify_ring(np.array([0.0, 0.0, 0.0, 0.001, 0.001]), np.array([0.0, 0.0005, 0.001, 0.001, 0.0]))
    assert keep.tolist() == [0, 2, 3, 4]
    assert len(osm.simplify_ring(np.zeros(6), np.zeros(6))) == 3


def test_lenient_numbers(spark):
    d = spark.createDataFrame([("12 m", 12.0), ("3,5", 3.5), ("x", None), (None, None), ("-2.5e1m", -25.0), ("", None)], "t string, want double")
    assert all(r.got == r.want for r in d.select(osm.lenient_number(F.col("t")).alias("got"), "want").collect())


def test_upper_median(spark):
    d = spark.createDataFrame([(1, float(v)) for v in (4, 1, 3, 2)] + [(2, 7.0)], "k int, v double")
    assert {r.k: r.median for r in terrain.upper_median(d, ["k"], "v").collect()} == {1: 3.0, 2: 7.0}


def test_smoothing_weights_equal_two_box_sums():
    n, reach = 11, 3
    box = np.array([[1 if abs(i - j) <= reach else 0 for j in range(n)] for i in range(n)])
    want = box @ box
    got = np.array([[max(0, min(i + reach, j + reach, n - 1) - max(i - reach, j - reach, 0) + 1) for j in range(n)] for i in range(n)])
    assert (want == got).all()


def test_innermost_area_ties_and_misses(spark):
    ring = lambda r: [{"lat": -r, "lon": -r}, {"lat": -r, "lon": r}, {"lat": r, "lon": r}, {"lat": r, "lon": -r}]
    areas = spark.createDataFrame([(i, [ring(r), [{"lat": p["lat"] + 1, "lon": p["lon"]} for p in ring(r)]], 8 * r * r, -r, -r, r + 1, r) for i, r in ((1, 0.02), (2, 0.01), (3, 0.01))], "i int, rings array<array<struct<lat:double,lon:double>>>, area double, s double, w double, n double, e double")
    points = spark.createDataFrame([(1, 0.001, 0.002), (2, 0.015, 0.0), (3, 1.0, 1.0), (4, 1.005, 0.0), (5, 0.5, 0.0)], "pid int, lat double, lon double")
    assert {r.pid: r.ground for r in spatial.innermost_area(points, areas).collect()} == {1: 2, 2: 1, 3: None, 4: 2, 5: None}


def metres_apart(a, b):
    return np.hypot((a[0] - b[0]) * geo.M_LAT, (a[1] - b[1]) * geo.M_LON)


def walk(places, rules):
    kept = []
    for i, name, *at in sorted(places):
        clash = any(metres_apart(at, b) < r.metres and (not r.same_name or (name is not None and name == other)) and all((n or "").endswith(r.ending) for n in (name, other)) for _, other, *b in kept for r in rules)
        if not clash:
            kept.append((i, name, *at))
    return {k[0] for k in kept}


def test_greedy_blocks_equal_a_plain_walk(spark):
    """A third of the places in one spot, long chains over block borders, and blocks that hold fewer than there are."""
    rng = np.random.default_rng(5)
    name = lambda: str(rng.choice(["a", "b", "c駅", "d駅"]))
    places = [(i, name(), 34.7 + rng.uniform(0, 2e-4), 135.5 + rng.uniform(0, 2e-4)) for i in range(0, 300, 3)]
    places += [(i, name(), 34.7 + rng.uniform(0, 0.03), 135.5 + rng.uniform(0, 0.03)) for i in range(1, 300, 3)]
    places += [(i, None if i % 5 == 0 else "a", 34.7, 135.4 + (i % 100) * 25e-5) for i in range(2, 300, 3)]  # a chain to the east, 23 metres a step
    places = [(i, n, float(a), float(b)) for i, n, a, b in places]
    frame = spark.createDataFrame([*places, (900, "a", None, 135.5)], "id int, name string, lat double, lon double").repartition(3)
    want = walk(places, labels.FACILITY_RULES) | {900}
    for block in (20_000, 15):
        gone = [r.id for r in greedy.greedy_apart(frame, labels.FACILITY_RULES, block).collect()]
        assert len(gone) == len(set(gone)) and {r.id for r in frame.collect()} - set(gone) == want
    assert {r.id for r in labels.suppressed_facilities(frame).collect()} == want
    same = labels.greedy_same_name(frame.filter("lat IS NOT NULL").select(F.col("id").alias("ord"), F.col("name").alias("ja"), "lat", "lon"), 500.0)
    assert {r.ord for r in same.collect()} == walk(places, (greedy.Rule(500.0, same_name=True),))
    assert greedy.greedy_apart(frame.limit(0), labels.FACILITY_RULES).count() == 0


def test_last_accepted_station_of_a_hot_name(spark):
    rng = np.random.default_rng(6)
    rows = [(i, str(rng.choice(["x", "x", "y"])) if i % 4 else None, float(34.7 + rng.uniform(0, 0.012)), float(135.5 + rng.uniform(0, 0.012))) for i in range(400)]
    rows += [(500 + i, "far", 34.7, 135.5) for i in range(60)] + [(600, "x", None, 1.0)]
    last, want = {}, set()
    for i, n, a, b in sorted(rows):
        if a is None:
            want.add(i)
        elif n not in last or metres_apart(last[n], (a, b)) >= 500:
            last[n] = (a, b)
            want.add(i)
    frame = spark.createDataFrame(rows, "seq int, name string, lat double, lon double").repartition(4)
    for rows_of_a_range in (20, 1000):
        got = [r.seq for r in labels.last_accepted(frame, 500.0, rows_of_a_range).collect()]
        assert sorted(got) == sorted(want)
    assert labels.last_accepted(frame.limit(0)).count() == 0


def test_smoothing_of_a_device_with_most_events(spark):
    """Ranges of a few events, one device over most of them: the rows of one walk per device."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"event_id": range(300), "device": np.where(rng.random(300) < 0.7, 1, rng.integers(2, 9, 300)), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(300) // 2, "s")})
    for c in ("alpha", "beta", "gamma"):
        pdf[c] = rng.integers(-40, 300, 300).astype(float)
    pdf.loc[7, "beta"] = None
    src = spark.createDataFrame(pdf).withColumn("beta", F.expr("nullif(beta, 'NaN')")).repartition(5)
    rows = sorted(devices.vectors(src).collect(), key=lambda r: (r.ts, r.event_id))
    state, want = {}, {}
    for r in rows:
        v = np.array([r.dx, r.dy, r.dz, r.ux, r.uy, r.uz])
        s = state.get(r.device)
        if s is not None:
            s = s + (v - s) * 0.25
            v = np.concatenate((s[:3] / np.linalg.norm(s[:3]), s[3:] / np.linalg.norm(s[3:])))
        state[r.device] = want[r.event_id] = v
    assert len(want) == 299
    for range_rows in (20, 100_000):
        got = {r.event_id: np.array([r.dx, r.dy, r.dz, r.ux, r.uy, r.uz]) for r in devices.smoothed(src, range_rows=range_rows).collect()}
        assert got.keys() == want.keys() and all(np.abs(got[i] - want[i]).max() < 1e-9 for i in want)


def test_roofs_and_selected_kinds(spark):
    ways = [("way", k, {"name": "x", key: value}) for k, (key, value) in enumerate(
        [("historic", v) for v in (*osm.HISTORIC_KINDS, "ruins")] + [("leisure", v) for v in (*osm.LEISURE_KINDS, "pitch")] + [("tourism", v) for v in (*osm.TOURISM_KINDS, "hotel")]
    )]
    d = spark.createDataFrame([(t, i, {**m, "wikidata": "Q"}, 34.7, 135.5) for t, i, m in ways] + [("way", 99, {"name": "x", "historic": "castle"}, 35.0, 135.5)], "type string, id long, tags map<string,string>, lat double, lon double")
    unknown = {k for k, (_, _, m) in enumerate(ways) if set(m.values()) & {"ruins", "pitch", "hotel"}}
    assert {r.id for r in osm.landmarks(d).collect()} == set(range(len(ways))) - unknown
    square = [{"lat": 0.0, "lon": 0.0}, {"lat": 0.0, "lon": 2e-4}, {"lat": 1e-4, "lon": 2e-4}, {"lat": 1e-4, "lon": 0.0}]
    e = spark.createDataFrame([(square, s, a) for s in ("hipped", "gabled") for a in (False, True)], "ring array<struct<lat:double,lon:double>>, shape string, across boolean")
    _, roof = osm.roof_surfaces(F.col("ring"), F.lit(0.0), F.lit(10.0), F.col("shape"), F.lit(4.0), F.col("across"))
    for r in e.select("shape", "across", roof.alias("roof")).collect():
        ridge = [(p["lat"], p["lon"]) for p in r.roof[0] if p["z"] == 10.0]
        assert len(r.roof) == 4 and [len(f) for f in r.roof] == [4, 4, 3, 3] and len(ridge) == 2
        along = 0 if r.across else 1  # the ridge keeps to the middle of the other axis
        assert all(abs(p[1 - along] - (1e-4 if r.across else 5e-5)) < 1e-9 for p in ridge)
        if r.shape == "gabled":
            assert {round(p[along], 7) for p in ridge} == ({0.0, 1e-4} if r.across else {0.0, 2e-4})


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streamed(spark, tmp_path, batches, schema, job, name, provider=None):
    """Rows of a stream of the batches, one after another, in append mode."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(key)
    try:
        spark.conf.set(key, provider or held)
        q = job(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    finally:
        spark.conf.set(key, held)
    return spark.sql(f"SELECT * FROM {name}").collect()


def feed(seed):
    """Three batches of (event_id, device, ts) whose rows come up to 8 seconds out of order, and one row that comes an hour late; the last moves the watermark."""
    rng = np.random.default_rng(seed)
    at = lambda s: (pd.Timestamp("2024-01-01 10:00") + pd.Timedelta(milliseconds=int(1000 * s))).to_pydatetime()
    rows = [(i, int(rng.integers(0, 4)), at(i * 1.7 - rng.uniform(0, 8))) for i in range(90)]
    late = (500, 9, at(-3600))
    return [rows[:30], rows[30:60], [*rows[60:], late], [(900, 8, at(3600))], [(901, 8, at(7200))]], rows


def test_first_pings_of_a_stream_equal_batch(spark, tmp_path):
    """With late and out-of-order rows, and enriched with heights on the way."""
    batches, good = feed(1)
    schema = "event_id long, device long, ts timestamp"
    store = stored_heights(spark, Grid(1.0, 0.0, 0.1, 10, 10), [[float(r + c) for c in range(10)] for r in range(10)]).saved()
    place = lambda d: devices.enriched(d.withColumns({"lat": 0.9 - F.col("event_id") % 7 / 10.0, "lon": 0.1 + F.col("event_id") % 5 / 10.0}), store, 1.5)
    rows = streamed(spark, tmp_path, batches, schema, lambda s: devices.first_flagged_stream(place(s)), "firsts", ROCKS)
    want = devices.first_flagged(place(spark.createDataFrame(good, schema))).collect()
    got = {r.event_id: (r["first"], round(r.eye, 9)) for r in rows if r.event_id < 900}
    assert got == {r.event_id: (r["first"], round(r.eye, 9)) for r in want}
    assert len(rows) == len({r.event_id for r in rows}) and sum(r["first"] for r in rows if r.event_id < 900) == 4


def test_settled_views_of_a_stream_equal_batch(spark, tmp_path):
    batches, good = feed(2)
    schema = "event_id long, device long, ts timestamp"
    rows = streamed(spark, tmp_path, batches, schema, lambda s: devices.settled_views(s, "5 seconds", "10 seconds"), "settled")
    want = devices.settled_views(spark.createDataFrame(good, schema), "5 seconds").collect()
    got = Counter((r.device, r.event_id, r.ts, r.n) for r in rows if r.device < 8)
    assert got == Counter((r.device, r.event_id, r.ts, r.n) for r in want) and len(want) > 6


def test_views_far_north_and_across_the_meridian(spark):
    v = spark.createDataFrame([(1, 70.0, 179.99, 10.0, 90.0, 0.0)], "view_id long, vlat double, vlon double, vh double, heading double, pitch double")
    l = spark.createDataFrame([(1, "l", 2, 70.0, -179.9, 0.0), (2, "l", 2, 70.0, 179.8, 0.0), (3, "l", 2, 70.0, -179.0, 0.0)], "id long, k string, r int, lat double, lon double, z double")
    assert {r.id for r in views.candidates(v, l).collect()} == {1}


def test_translation_words():
    assert labels.translate_terms("十三駅") == "Juso Station"
    assert labels.translate_terms("金胎寺山") == "Kontaiji山"
    assert labels.translate_terms("ヴィラ・マッチャ(北館)") == "Vira Matcha (North Wing)"
    assert labels.translate_terms("大阪市立図書館") == "Osaka City Library"
    assert labels.translate_terms("グランドビル") == "Grand Building"
    assert labels.translate_terms("寺田") == "寺田"
    assert labels.translate_terms("なんば・てんま・サンプル・コンマ・しんいち・カンナ・ほんぱ・ん") == "Namba Tenma Sampuru Komma Shinichi Kanna Hompa N"
    assert labels.translate_terms("") == ""


def test_geodetic_round_trip(spark):
    d = spark.createDataFrame([(34.7, 135.5, 120.0), (-10.0, -70.0, 0.0), (0.0, 0.0, 5.0)], "lat double, lon double, h double")
    lat, lon, h = geo.geodetic(*geo.ecef(F.col("lat"), F.col("lon"), F.col("h")))
    for r in d.select("lat", "lon", "h", lat.alias("a"), lon.alias("b"), h.alias("c")).collect():
        assert abs(r.lat - r.a) < 1e-9 and abs(r.lon - r.b) < 1e-9 and abs(r.h - r.c) < 1e-4


def test_chunks_share_and_repeat_borders(spark):
    grid = Grid(0.0, 0.0, 1.0, 5, 7)
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(5) for c in range(7)], "r int, c int, z double")
    got = {(r.cr, r.cc, r.y, r.x): r.z_dm for r in terrain.chunked(cells, grid, 4).collect()}
    want = {(a, b, y, x): 10 * (10 * min(4 * a + y, 4) + min(4 * b + x, 6)) for a in range(2) for b in range(2) for y in range(5) for x in range(5)}
    assert got == want


def test_packing_is_next_fit(spark):
    d = spark.createDataFrame([("m", "t", i, n) for i, n in enumerate((4, 5, 20, 2, 9))], "mesh string, cls string, seq long, nv long")
    got = {r.seq: r.prim for r in buildings.packed_primitives(d, 10).collect()}
    assert got == {0: 0, 1: 0, 2: None, 3: 1, 4: 2}


def test_view_links(spark):
    d = spark.createDataFrame([("#v=1,2,3,4,5&look=1", True), ("#v=1,2,3,4", False), ("#v=1,2,x,4,5", False), ("", False)], "t string, ok boolean")
    assert all((r.v is not None) == r.ok for r in d.select(views.parsed_view(F.col("t")).alias("v"), "ok").collect())


def test_smoothing_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"event_id": range(40), "device": rng.integers(0, 3, 40), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(40), "s")})
    for c in ("alpha", "beta", "gamma"):
        pdf[c] = rng.integers(-40, 300, 40).astype(float)
    src = spark.createDataFrame(pdf)
    for i in range(2):
        src.filter(f"event_id div 20 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = devices.smoothed_stream(stream).writeStream.format("memory").queryName("smoothed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: round(r.dx, 9) for r in spark.sql("SELECT * FROM smoothed").collect()}
    assert got == {r.event_id: round(r.dx, 9) for r in devices.smoothed(src).collect()}


def stored_heights(spark, grid, z, lo=None, size=4, halo=2):
    cells = [(r, c, float(v)) for r, row in enumerate(z) for c, v in enumerate(row) if v is not None]
    over = None if lo is None else spark.createDataFrame([(r, c, int(v)) for r, row in enumerate(lo) for c, v in enumerate(row)], "r int, c int, z_dm int")
    return heights.height_store(spark.createDataFrame(cells, "r int, c int, z double"), grid, size, halo, over)


def test_heights_from_chunks_equal_the_grid(spark):
    rng = np.random.default_rng(4)
    grid = Grid(10.0, 20.0, 0.5, 11, 14)
    z = [[None if rng.random() < 0.1 else float(rng.integers(-500, 9000)) / 10 for _ in range(14)] for _ in range(11)]
    lo = rng.integers(-50, 900, (3, 4))
    store = stored_heights(spark, grid, z, lo.tolist())
    points = [(i, float(rng.uniform(3, 12)), float(rng.uniform(18, 29))) for i in range(300)] + [(300 + k, 10.0 - a * 0.5, 20.0 + b * 0.5) for k, (a, b) in enumerate([(0, 0), (11, 14), (4, 4), (8, 12), (3.5, 7.5)])] + [(400, None, 21.0)]
    frame = spark.createDataFrame(points, "id int, lat double, lon double").repartition(3)

    def between(g, get, lat, lon):
        x, y = min(max((lon - 20) / g.res - 0.5, 0), g.cols - 1), min(max((10 - lat) / g.res - 0.5, 0), g.rows - 1)
        x0, y0 = int(x), int(y)
        four = [(get(r, c), w) for r, wy in ((y0, 1 - (y - y0)), (min(y0 + 1, g.rows - 1), y - y0)) for c, wx in ((x0, 1 - (x - x0)), (min(x0 + 1, g.cols - 1), x - x0)) for w in (wy * wx,)]
        return sum(v * w for v, w in four if v is not None), all(v is not None for v, _ in four)

    clamp = lambda v, n: min(max(v, 0), n - 1)
    near = {r.id: r.ground for r in heights.nearest_height(frame, store).collect()}
    fine = {r.id: r.height for r in heights.bilinear_height(frame, store).collect()}
    both = {r.id: r.height for r in heights.bilinear_with_fallback(frame, store).collect()}
    only = {r.id: r.height for r in heights.bilinear_with_fallback(frame, store, F.col("id") % 2 == 0).collect()}
    top = {r.id: (r.hr, r.hc, r.hz) for r in heights.highest_around(frame, store).collect()}
    assert len(near) == len(points) and near[400] is None and fine[400] == both[400] == 0.0 and top[400] == (None, None, None)
    for i, lat, lon in points[:-1]:
        r, c = int(np.floor((10 - lat) / 0.5)), int(np.floor((lon - 20) / 0.5))
        v = z[clamp(r, 11)][clamp(c, 14)]
        assert near[i] == (None if v is None else np.floor(v / 0.1 + 0.5) * 0.1)
        inside = 4.5 <= lat <= 10 and 20 <= lon <= 27
        a, whole = between(grid, lambda r, c: z[r][c], lat, lon)
        b, _ = between(terrain.coarser(grid), lambda r, c: lo[r][c] * 0.1, lat, lon)
        assert abs(fine[i] - (a if inside else 0)) < 1e-9
        assert abs(both[i] - ((a if whole else b) if inside else 0)) < 1e-9
        assert abs(only[i] - ((a if whole and i % 2 == 0 else b) if inside else 0)) < 1e-9
        around = {(clamp(r + y, 11), clamp(c + x, 14)) for y in range(-2, 3) for x in range(-2, 3)}
        known = [(-z[y][x], y, x) for y, x in around if z[y][x] is not None]
        assert top[i] == ((min(known)[1], min(known)[2], -min(known)[0]) if known else (None, None, None))


def test_heights_take_one_shuffle_of_the_points(spark):
    store = stored_heights(spark, Grid(1.0, 0.0, 0.1, 10, 10), [[1.0] * 10] * 10).saved()
    store = heights.Heights(store.chunks.hint("merge"), store.grid, store.size, store.halo, store.factor)
    points = spark.createDataFrame([(i, 0.5, 0.5) for i in range(9)], "id int, lat double, lon double")
    plan = heights.bilinear_height(points, store)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Generate" not in plan and "Aggregate" not in plan


def crowded(seed):
    """Points of which a third lies in one place and some at borders; areas of all sizes, one over all."""
    rng = np.random.default_rng(seed)
    at = [(34.5005, 135.5005)] * 150 + [(float(rng.uniform(34.5, 34.501)), float(rng.uniform(135.5, 135.501))) for _ in range(100)] + [(float(rng.uniform(34.4, 34.6)), float(rng.uniform(135.4, 135.6))) for _ in range(150)]
    points = [(i, a, b) for i, (a, b) in enumerate(at)] + [(900, 34.5, 135.5), (901, None, 135.5), (902, -34.5, -135.5)]
    boxes = [(34.4, 135.4, 34.6, 135.6), (-90.0, -180.0, 90.0, 180.0), (34.5, 135.5, 34.5, 135.5), (34.5005, 135.5005, 34.5005, 135.5005), (None, None, None, None)]
    for _ in range(120):
        a, b, d = (rng.uniform(34.495, 34.505), rng.uniform(135.495, 135.505), 10 ** rng.uniform(-5, -1.5))
        boxes.append((float(a), float(b), float(a + d * rng.uniform(0.1, 1)), float(b + d)))
    return points, [(i, *b) for i, b in enumerate(boxes)]


def test_quadtree_join_equals_all_pairs(spark, monkeypatch):
    """Full cells listed in the plan, as a table, and none."""
    for seed, capacity, depth, listed in ((1, 20, 4, 2000), (2, 5, 2, 3), (3, 100000, 6, 2000)):
        monkeypatch.setattr(spatial, "LISTED", listed)
        points, boxes = crowded(seed)
        p = spark.createDataFrame(points, "pid int, lat double, lon double").repartition(3)
        a = spark.createDataFrame(boxes, "i int, s double, w double, n double, e double").repartition(2)
        tree = spatial.tree_of(p, a, 0.001, capacity, depth, share=2 * capacity)
        assert (tree.listed is None) == (listed == 3)
        want = sorted((i, k) for i, lat, lon in points if lat is not None for k, s, w, n, e in boxes if s is not None and s <= lat <= n and w <= lon <= e)
        got = spatial.points_in_boxes(p, a, 0.001, tree)
        assert sorted((r.pid, r.i) for r in got.collect()) == want
        every = F.lit(True)
        keyed = spatial.keyed_boxes(a, tree)
        assert {r.pid for r in spatial._meets(spatial.keyed_points(p, tree), keyed, every).collect()} == {i for i, _ in want}
        assert {r.i for r in spatial._meets(keyed, spatial.keyed_points(p, tree), every).collect()} == {k for _, k in want}
        above = keyed.filter("__lv < 0").groupBy("i", "__share").count().agg(F.max("count")).first()[0]
        assert above <= 4  # however large an area is


def test_hot_cells_are_split(spark):
    """No key holds much more than the capacity, though a third of the points lies in one place under an area of the whole city."""
    rng = np.random.default_rng(7)
    points = [(i, 34.5005, 135.5005) for i in range(2000)] + [(2000 + i, float(34.4 + rng.uniform(0, 0.2)), float(135.4 + rng.uniform(0, 0.2))) for i in range(4000)]
    p = spark.createDataFrame(points, "pid int, lat double, lon double")
    a = spark.createDataFrame([(0, 34.4, 135.4, 34.6, 135.6), (1, 34.5, 135.5, 34.501, 135.501)], "i int, s double, w double, n double, e double")
    tree = spatial.tree_of(p, a, 0.005, 200, 4, share=200)
    most = spatial.keyed_points(p, tree).groupBy(*spatial._KEY).count().agg(F.max("count")).first()[0]
    assert most < 300
    assert spatial.points_in_boxes(p, a, 0.005, tree).groupBy("i").count().filter("i = 0").first()["count"] == len(points)


def test_one_document_is_read_by_several_tasks(spark, tmp_path):
    """Nodes, ways and relations with members, on one line and on many, in splits smaller than some elements."""
    rng = np.random.default_rng(2)
    point = lambda: {"lat": float(rng.integers(0, 90)), "lon": float(rng.integers(0, 180))}
    trap = 'a } {"type":"node","id":1} ] { \\ "é日本'
    made = []
    for i in range(120):
        kind = ("node", "way", "relation")[i % 3]
        e = {"type": kind, "id": i}
        if kind == "node":
            e |= point()
        elif kind == "way":
            e |= {"nodes": [1, 2, 3], "geometry": [point() for _ in range(int(rng.integers(0, 40)))]}
        else:
            e["members"] = [{"type": "way", "ref": k, "role": role, "geometry": [point() for _ in range(5)]} for k, role in enumerate(("outer", "inner"))]
        e["tags"] = {"name": f"n{i}", "type": "multipolygon", "id": "7", "note": trap}
        made.append(e)
    for name, indent in (("one", None), ("many", 2)):
        (tmp_path / name).mkdir()
        for part in ("a", "b"):
            doc = {"version": 0.6, "osm3s": {"x": "}"}, "elements": made if part == "a" else made[:7], "remark": {"id": 3}}
            (tmp_path / name / f"{part}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=indent is None))
        held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        try:
            for k in held:
                spark.conf.set(k, "700" if "max" in k else "0")
            rows = readers.osm_elements(spark, f"file://{tmp_path}/{name}").collect()
            assert spark.read.option("lineSep", "}").text(f"file://{tmp_path}/{name}").rdd.getNumPartitions() > 20
        finally:
            for k, v in held.items():
                spark.conf.set(k, v)
        for part, want in (("a", made), ("b", made[:7])):
            got = sorted((r for r in rows if r.file.endswith(f"{part}.json")), key=lambda r: r.seq)
            assert [r.seq for r in got] == list(range(len(want)))
            for r, e in zip(got, want, strict=True):
                assert (r.type, r.id, r.lat, r.lon, r.tags) == (e["type"], e["id"], e.get("lat"), e.get("lon"), e["tags"])
                assert [p.asDict() for p in r.geometry or []] == e.get("geometry", [])
                assert [(m.ref, m.role, len(m.geometry)) for m in r.members or []] == [(m["ref"], m["role"], 5) for m in e.get("members", [])]


def test_a_document_is_written_in_order(spark, tmp_path):
    d = spark.createDataFrame([(i * 7 % 100, f"t{i * 7 % 100}") for i in range(100)] + [(500, None)], "k int, t string").repartition(7)
    parts = writers.write_document(d, [F.col("k")], F.col("t"), f"file://{tmp_path}/out", "doc", "<", "|", ">", part_rows=15).collect()
    text = (tmp_path / "out" / "doc").read_text()
    assert text == "<" + "|".join(f"t{i}" for i in range(100)) + ">"
    assert len(parts) > 3 and all(text[p.offset :].startswith(f"t{sum(q.records for q in parts if q.part < p.part)}") for p in parts) and sum(p.records for p in parts) == 100
    writers.write_document(d.limit(0), [F.col("k")], F.col("t"), f"file://{tmp_path}/out", "none", "[", ",", "]")
    assert (tmp_path / "out" / "none").read_text() == "[]"


def test_declutter_equals_a_plain_walk(spark):
    """One view has most of the boxes, more than a round looks at."""
    rng = np.random.default_rng(11)
    rows = [(1 if i % 4 else int(rng.integers(2, 5)), i, float(rng.integers(0, 50)), *map(float, (x := rng.integers(0, 400), y := rng.integers(0, 300), x + rng.integers(5, 60), y + rng.integers(5, 30))), bool(rng.random() < 0.8)) for i in range(600)]
    frame = spark.createDataFrame([*rows, (1, 900, None, 0.0, 0.0, 1.0, 1.0, True)], "view_id long, id long, ord double, x0 double, y0 double, x1 double, y1 double, clear boolean").repartition(5)
    for most, prefix in ((20, 15), (70, 512), (3, 40)):
        want = set()
        for v in {r[0] for r in rows}:
            held = []
            for _, i, _, *b, clear in sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[1])):
                if len(held) < most and clear and not any(b[0] < h[2] and b[2] > h[0] and b[1] < h[3] and b[3] > h[1] for h in held):
                    held.append(b)
                    want.add(i)
        assert {r.id for r in views.declutter(frame, most, prefix).collect()} == want
    assert views.declutter(frame.limit(0)).count() == 0


def test_declutter_of_a_crowded_view_takes_few_steps(spark, monkeypatch):
    """Thousands of boxes lie over each other before the next free one comes; steps do not follow their number."""
    rng = np.random.default_rng(17)
    xs, ys = rng.uniform(0, 900, 20_000), rng.uniform(0, 700, 20_000)
    rows = sorted((float(np.hypot(x - 450, y - 350)), i % 7, i, float(x), float(y), float(x) + 60, float(y) + 25) for i, (x, y) in enumerate(zip(xs, ys, strict=True)))
    held = []
    for o, _, i, *b in rows:
        if len(held) < 70 and not any(b[0] < h[2] and b[2] > h[0] and b[1] < h[3] and b[3] > h[1] for _, h in held):
            held.append((i, b))
    assert len(held) == 70
    frame = spark.createDataFrame([(1, r[2], r[0], *r[3:], True) for r in rows], "view_id long, id long, ord double, x0 double, y0 double, x1 double, y1 double, clear boolean").repartition(6)
    steps, real = [], views.written
    monkeypatch.setattr(views, "written", lambda d, name: steps.append(name) or real(d, name))
    assert {r.id for r in views.declutter(frame).collect()} == {i for i, _ in held}
    assert len(steps) <= 5


def test_line_of_sight_equals_all_samples(spark):
    """Hills and plains, lines within the grid and beyond it; lines whose stretches are cleared take few samples."""
    rng = np.random.default_rng(12)
    n = 96
    y, x = np.mgrid[0:n, 0:n]
    z = 40 + 300 * np.exp(-((y - 30) ** 2 + (x - 50) ** 2) / 60) + 200 * np.exp(-((y - 70) ** 2 + (x - 20) ** 2) / 20) + rng.uniform(0, 5, (n, n))
    grid = Grid(34.9, 135.3, 0.002, n, n)
    holes = [[None if rng.random() < 0.02 else float(v) for v in row] for row in z]
    store = stored_heights(spark, grid, holes, size=16).saved()
    cells = spark.createDataFrame([(r, c, v) for r, row in enumerate(holes) for c, v in enumerate(row) if v is not None], "r int, c int, z double")
    place = lambda: (float(rng.uniform(34.68, 34.92)), float(rng.uniform(135.28, 135.52)))
    pairs = [(str(k), *place(), float(rng.uniform(60, 260)), *place(), float(rng.uniform(50, 200))) for k in range(150)]
    frame = spark.createDataFrame(pairs, "pair string, vlat double, vlon double, vh double, lat double, lon double, z double")
    frame = frame.withColumn("dist", geo.plane_distance(F.col("vlat"), F.col("vlon"), F.col("lat"), F.col("lon"))).cache()
    samples = views.sight_samples(frame)
    high = heights.bilinear_height(samples, store).filter(F.col("height") > F.col("h") + 3 + F.col("f") * 8)
    want = {p[0] for p in pairs} - {r.pair for r in high.select("pair").distinct().collect()}
    pyramid = views.height_pyramid(cells)
    assert {r.pair for r in views.in_sight(frame, store, pyramid).collect()} == want and 20 < len(want) < 130
    doubtful = views.doubtful_stretches(frame, pyramid, grid)
    assert doubtful.count() < samples.count() / views.STRETCH / 2


def test_places_of_buildings(spark):
    b = spark.createDataFrame([(1, "Hall", "A", "House"), (2, "", "A", "House"), (3, "Hall", "", ""), (4, None, None, ""), (5, "Keep", "C", ""), (6, "x", "none", "")], "pid int, name string, tn string, usage string")
    l = spark.createDataFrame([(2, "t", "A", 2), (1, "t", "A", 1), (3, "l", "C", 1), (4, "t", "C", 4)], "seq int, k string, ja string, g int")
    out = {r.pid: (r.title, r.place_kind, r.place) for r in views.building_rows(b, l).collect()}
    assert out == {1: ("Hall", "Temple", "A"), 2: ("Building at A", None, None), 3: ("Hall", None, None), 4: ("—", None, None), 5: ("Keep", "Castle", "C"), 6: ("x", "Place of worship", "none")}


def test_label_product(spark):
    """Every kind of label: names in English as known, by the element of the same name, by words, and grounds without rings."""
    grid = Grid(34.8, 135.4, 0.01, 20, 20)
    z = [[20.0 if r < 10 else 0.0 for _ in range(20)] for r in range(20)]
    z[5][5] = 650.0
    store = stored_heights(spark, grid, z, size=8).saved()
    peaks = spark.createDataFrame([(1, "愛宕山", 34.745, 135.455, None, False, None), (2, "甲峰", 34.745, 135.555, "300", True, "Mount Kabuto"), (3, "海", 34.62, 135.55, None, False, None)], "seq long, name string, lat double, lon double, ele string, wikidata boolean, name_en string")
    ring = lambda a, b, d: [{"lat": a - d, "lon": b - d}, {"lat": a - d, "lon": b + d}, {"lat": a + d, "lon": b + d}, {"lat": a + d, "lon": b - d}]
    box = lambda a, b, d: (a - d, b - d, a + d, b + d)
    grounds = spark.createDataFrame(
        [
            (1, "大阪城", 4, 2, 34.70, 135.50, [ring(34.70, 135.50, 0.002)], *box(34.70, 135.50, 0.002), "Osaka Castle", "ja:大阪城"),
            (2, "寺", 1, 3, 34.71, 135.51, [], *box(34.71, 135.51, 0.002), "てら", ""),
            (3, "図書館神社", 2, 3, 34.66, 135.45, [], *box(34.66, 135.45, 0.001), None, None),
        ],
        "i long, name string, rel int, r int, lat double, lon double, rings array<array<struct<lat:double,lon:double>>>, s double, w double, n double, e double, en string, wikipedia string",
    ).withColumn("area", geo.rings_area(F.col("rings")))
    points = spark.createDataFrame([(1, 34.7005, 135.5005, 5.0, 45.0), (2, 34.7008, 135.5008, 5.0, 60.0), (3, 34.7101, 135.5101, 3.0, 13.0), (4, 34.75, 135.52, 0.0, 100.0), (5, 34.7501, 135.5203, 0.0, 30.0), (6, 34.72, 135.53, 2.0, 12.0)], "seq long, lat double, lon double, base double, top double")
    geometry, members = "array<struct<lat:double,lon:double>>", "array<struct<role:string,geometry:array<struct<lat:double,lon:double>>>>"
    elements = spark.createDataFrame(
        [
            ("node", 1, 1, 34.75, 135.52, {"name": "梅田", "railway": "station", "name:en": "Umeda"}, None, None),
            ("node", 2, 2, 34.752, 135.52, {"name": "梅田", "railway": "station"}, None, None),
            ("node", 3, 3, 34.68, 135.48, {"name": "市立博物館", "tourism": "museum", "wikidata": "Q1"}, None, None),
            ("node", 4, 4, 34.7199, 135.5301, {"name": "中央ビル", "name:en": "Central・House", "leisure": "park"}, None, None),
            ("node", 5, 5, 34.69, 135.49, {"name": "大阪城", "wikidata": "Q2"}, None, None),
            ("relation", 6, 6, None, None, {"name": "記念公園", "wikipedia": "ja:x"}, None, [{"role": "outer", "geometry": ring(34.73, 135.45, 0.001)}, {"role": "inner", "geometry": ring(1.0, 1.0, 0.001)}]),
        ],
        f"type string, id long, seq long, lat double, lon double, tags map<string,string>, geometry {geometry}, members {members}",
    )
    facilities = spark.createDataFrame([(10, "中央ビル", 34.72, 135.53, 2.0, 12.0), (11, "中央ビル", 34.7201, 135.5302, 2.0, 80.0), (12, "梅田駅", 34.7502, 135.5206, 0.0, 30.0), (13, "南館", 34.65, 135.42, 1.0, 4.0)], "seq long, name string, lat double, lon double, base double, top double")
    out = city.label_table(peaks, grounds, elements, facilities, points, store).orderBy("place").collect()
    got = [(r.k, r.ja, r.en, round(r.lat, 4), round(r.lon, 4), r.z, r.r, r.e, r.g, r.w) for r in out]
    assert got == [
        ("p", "愛宕山", "Mt. Atago", 34.745, 135.455, 652.0, 1, 650.0, None, None),
        ("p", "甲峰", "Mt. Kabuto", 34.745, 135.555, 22.0, 1, 300.0, None, None),
        ("t", "大阪城", "Osaka Castle", 34.7008, 135.5008, 63.0, 1, 55.0, 4, "ja:大阪城"),
        ("s", "梅田駅", "Umeda Station", 34.75, 135.52, 103.0, 2, None, None, None),
        ("l", "市立博物館", "Municipal Museum", 34.68, 135.48, 8.0, 2, None, None, None),
        ("l", "記念公園", labels.translate_terms("記念公園"), 34.73, 135.45, 28.0, 2, None, None, None),
        ("t", "寺", "Temple", 34.7101, 135.5101, 16.0, 3, 10.0, 1, None),
        ("f", "中央ビル", "Central House", 34.72, 135.53, 15.0, 3, 10.0, None, None),
        ("f", "南館", "South Wing", 34.65, 135.42, 7.0, 3, 3.0, None, None),
        ("t", "図書館神社", "Library Shrine", 34.66, 135.45, 8.0, 3, None, 2, None),
    ]


def test_solids_of_large_rings(spark):
    """A ring of many points is worked out once, not once for each of its points; no bottom, no height and no text give no solid."""
    def polygon(z, n):
        points = [f"{34.6 + 0.001 * math.cos(6.28 * k / n):.7f} {135.5 + 0.001 * math.sin(6.28 * k / n):.7f} {z + (k % 2 if z == 9 else 0)}" for k in range(n)]
        return f"<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>{' '.join(points + points[:1])}</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>"

    solid = lambda *polygons: f"<bldg:lod1Solid>{''.join(polygons)}</bldg:lod1Solid>"
    texts = [(1, solid(polygon(5, 2000), polygon(1, 2000))), (2, solid(polygon(9, 4))), (3, solid(polygon(1, 4))), (4, ""), (5, None), (6, solid(polygon(9, 4), polygon(12, 4)))]
    found = spark.createDataFrame(texts, "id int, xml string").select("id", readers.lod1_solids(F.col("xml")).alias("s"))
    got = {r["id"]: [(len(s["ext"]), s["zb"], s["zt"]) for s in r["s"] or []] for r in found.collect()}
    assert got == {1: [(2000, 1.0, 5.0)], 2: [], 3: [], 4: [], 5: [], 6: [(4, 9.0, 12.0)]}


def test_conflict_pairs_of_a_crowded_place(spark):
    """Hundreds of stations and halls within a few hundred metres: every pair once, none shuffled to be compared with others."""
    rng = np.random.default_rng(23)
    names = ["梅田駅", "北館", "公園", None]
    rows = [(i, names[int(rng.integers(4))], *(float(v) for v in np.array([34.6, 135.4]) + rng.uniform(0, 0.012 if i % 3 else 0.001, 2))) for i in range(700)]
    rows += [(700, "北館", None, 135.4), (701, "北館", 34.6, None)]
    frame = spark.createDataFrame(rows, "id long, name string, lat double, lon double")
    want = set()
    for a, n, y, x in rows[:700]:
        for b, m, v, u in rows[a + 1 : 700]:
            d = math.sqrt(((y - v) * geo.M_LAT) ** 2 + ((x - u) * geo.M_LON) ** 2)
            if d < 40 or (n is not None and n == m and (d < 300 or (n.endswith("駅") and d < 800))):
                want.add((a, b))
    pairs = labels.conflicts(frame)
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10_000
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # no comparison of all pairs


def _crowd(rng, n, spread=0.004):
    """Places, half of them within a few metres; some on top of each other."""
    at = np.array([34.6, 135.4]) + np.where(np.arange(n)[:, None] % 2, rng.uniform(0, spread, (n, 2)), rng.uniform(0, 0.00005, (n, 2)))
    return [tuple(float(v) for v in np.round(p, 6)) for p in at]


def test_nearest_of_a_crowd_and_no_row_for_each_share(spark, monkeypatch):
    """Queries take few rows however many points there are: what comes from leaves is a row for each query and leaf that it meets."""
    rng = np.random.default_rng(29)
    points = [(i, *p) for i, p in enumerate(_crowd(rng, 3000))]
    queries = [(i, *p) for i, p in enumerate(_crowd(rng, 400, 0.006))] + [(900, None, 135.4), (901, 10.0, 10.0)]
    p, q = spark.createDataFrame(points, "seq long, lat double, lon double"), spark.createDataFrame(queries, "qid long, lat double, lon double")
    want = {}
    for i, y, x in queries:
        near = [(math.sqrt(((y - v) * geo.M_LAT) ** 2 + ((x - u) * geo.M_LON) ** 2), s) for s, v, u in points] if y is not None else []
        near = min((t for t in near if t[0] < 60.0), default=(None, None))
        want[i] = (near[1], near[0])
    for capacity in (40, 4096):
        got = {r.qid: (r.nearest, r.dist) for r in spatial.nearest_within(q, p, 60.0, capacity).collect()}
        assert got == want and sum(v[0] is not None for v in got.values()) > 200
    met = []
    real = spatial._Nearest.around
    monkeypatch.setattr(spatial._Nearest, "around", lambda self, d: met.append(real(self, d)) or met[-1])
    spatial.nearest_within(q, p, 60.0, 40)
    assert met[0].count() < 4 * len(queries)


def test_one_within_of_equal_names(spark):
    rng = np.random.default_rng(31)
    names = ["a", "b", None]
    points = [(names[int(rng.integers(3))], *p) for p in _crowd(rng, 500)]
    queries = [(i, names[int(rng.integers(3))], *p) for i, p in enumerate(_crowd(rng, 500, 0.02))]
    p, q = spark.createDataFrame(points, "name string, lat double, lon double"), spark.createDataFrame(queries, "qid long, name string, lat double, lon double")
    close = lambda a, b, m: math.sqrt(((a[0] - b[0]) * geo.M_LAT) ** 2 + ((a[1] - b[1]) * geo.M_LON) ** 2) < m
    for metres, key, capacity in ((40.0, None, 30), (300.0, "name", 30), (300.0, "name", 4096)):
        want = {i for i, n, *at in queries if any(close(at, b, metres) and (key is None or (n is not None and n == m)) for m, *b in points)}
        assert {r.qid for r in spatial.with_one_within(q, p, metres, key, capacity).collect()} == want and 100 < len(want) < 450


def test_tallest_in_crowded_areas_sorts_no_pairs(spark):
    """Rings of several sizes, with two rings, without points, with equal heights and heights that are missing."""
    rng = np.random.default_rng(37)
    points = [(i, *p, [None, 5.0, 9.0, float(i % 50)][int(rng.integers(4))]) for i, p in enumerate(_crowd(rng, 3000))]
    ring = lambda y, x, r, k: [(y + r * math.sin(2 * math.pi * j / k), x + r * math.cos(2 * math.pi * j / k)) for j in range(k)]
    areas = [(i, [ring(y, x, float(rng.uniform(0.00001, 0.0008)), int(rng.integers(3, 7))), *([ring(y + 0.002, x, 0.0003, 4)] if i % 5 == 0 else [])]) for i, (y, x) in enumerate(_crowd(rng, 200, 0.006))]
    a = spark.createDataFrame([(i, [[{"lat": y, "lon": x} for y, x in r] for r in rings]) for i, rings in areas], "i long, rings array<array<struct<lat:double,lon:double>>>")
    a = a.withColumns(geo.ring_bounds(F.flatten("rings")))
    p = spark.createDataFrame(points, "seq long, lat double, lon double, top double")

    def inside(y, x, r):
        return sum((a[0] > y) != (b[0] > y) and x < (b[1] - a[1]) * (y - a[0]) / (b[0] - a[0]) + a[1] for a, b in zip(r, [r[-1], *r[:-1]], strict=True)) % 2 == 1

    def first(rings):
        found = [(t is not None, t or 0.0, -s) for s, y, x, t in points if any(inside(y, x, r) for r in rings)]
        return -max(found)[2] if found else None

    want = {i: first(rings) for i, rings in areas}
    got = spatial.tallest_inside(a, p)
    assert {r.i: r.tallest for r in got.collect()} == want and 20 < sum(v is None for v in want.values()) < 180
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()  # pairs are not sorted, which would take their disk
