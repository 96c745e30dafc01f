"""Building tables: solids from rings, representative points, packing, sidecars and manifests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityjobs.functions import geo


def ring_of_numbers(text: Column) -> Column:
    """Points (lat, lon, z) of a list of numbers; a last point over the first is left out."""
    numbers = F.transform(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+"), lambda x: x.try_cast("double"))

    def points(v: Column) -> Column:
        n = F.floor(F.size(v) / 3).cast("int")
        return F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(v, 3 * i).alias("lat"), F.get(v, 3 * i + 1).alias("lon"), F.get(v, 3 * i + 2).alias("z"))))

    def opened(pts: Column) -> Column:
        n = F.size(pts)
        first, last = F.get(pts, 0), F.get(pts, n - 1)
        closed = (n > 1) & (first["lat"] == last["lat"]) & (first["lon"] == last["lon"])
        return F.when(closed, F.slice(pts, F.lit(1), n - 1)).otherwise(pts)

    return geo.named(geo.named(numbers, points), opened)


def solid_of_polygons(polygons: Column) -> Column:
    """The prism (ext, holes, zb, zt) of a solid's polygons: its bottom is the first polygon flat at the least height,
    else the first flat at the greatest; null without one or when it is lower than 0.1."""

    def solid(real: Column) -> Column:
        z = F.flatten(F.transform(real, lambda p: F.transform(p["ext"], lambda q: q["z"])))
        flat_at = lambda h: F.get(F.filter(real, lambda p: F.forall(p["ext"], lambda q: F.abs(q["z"] - h) < 1e-3)), 0)

        def between(b: Column) -> Column:
            high = b["zt"] - b["zb"] >= 0.1
            prism = lambda p: F.when(p.isNotNull() & high, F.struct(p["ext"].alias("ext"), p["holes"].alias("holes"), b["zb"].alias("zb"), b["zt"].alias("zt")))
            return geo.named(F.coalesce(flat_at(b["zb"]), flat_at(b["zt"])), prism)

        return geo.named(geo.named(z, lambda v: F.struct(F.array_min(v).alias("zb"), F.array_max(v).alias("zt"))), between)

    return geo.named(F.filter(polygons, lambda p: F.size(p["ext"]) >= 3), solid)


def representative_point(solids: Column) -> tuple[Column, Column]:
    """Vertex mean of the exterior with the most vertices, the first of equals."""
    most = F.array_max(F.transform(solids, lambda s: F.size(s["ext"])))
    ring = geo.named(most, lambda m: F.get(F.filter(solids, lambda s: F.size(s["ext"]) == m), 0)["ext"])
    mean = lambda f: geo.named(ring, lambda r: geo.ring_mean(r, f))
    return mean("lat"), mean("lon")


def batch_ids(buildings: DataFrame) -> DataFrame:
    """``batch_id``: place in the order (seq) of the tile (mesh, cls)."""
    n = F.row_number().over(Window.partitionBy("mesh", "cls").orderBy("seq")) - 1
    return buildings.withColumn("batch_id", n.cast("long"))


def packed_primitives(buildings: DataFrame, most: int) -> DataFrame:
    """``prim``: running pack of vertex counts (nv) in order within (mesh, cls); a new one starts when ``most`` would be
    passed. Items over ``most`` have none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        prim, used, out = 0, 0, []
        for nv in pdf["nv"]:
            if nv > most:
                out.append(None)
                continue
            if used + nv > most:
                prim, used = prim + 1, 0
            used += nv
            out.append(prim)
        return pdf.assign(prim=pd.array(out, dtype="Int64"))

    slim = buildings.select("mesh", "cls", "seq", "nv")
    return slim.groupBy("mesh", "cls").applyInPandas(run, "mesh string, cls string, seq long, nv long, prim long")


def named_rows(buildings: DataFrame) -> DataFrame:
    """What labels are made of: name, place, top, base, usage and id of the buildings (pid, ...) with a name."""
    near = lambda c, n: geo.round_half_up(F.col(c), n).alias(c)
    return buildings.filter("name <> ''").select("name", near("lat", 6), near("lon", 6), near("top", 1), near("base", 1), "u", F.col("pid").alias("id"))


def footprint_rows(buildings: DataFrame) -> DataFrame:
    """Rings (ring) of buildings (id) as pairs of latitude and longitude to seven digits."""
    seven = lambda v: geo.round_half_up(v, 7)
    return buildings.select("id", F.transform("ring", lambda p: F.array(seven(p["lat"]), seven(p["lon"]))).alias("ring"))


def statistics(buildings: DataFrame) -> DataFrame:
    """Per mesh and in all (mesh null): buildings, skipped ones, those in grounds, with surfaces and with names, tiles and ground cells.

    ``buildings`` has mesh, cls, ground, name, cell, lod2, and valid for those that have a solid.
    """
    of = lambda c: F.when(F.col("valid"), c)
    count = lambda c: F.count_if(F.col("valid") & c)
    return buildings.rollup("mesh").agg(
        F.count_if("valid").alias("n"), F.count_if(~F.col("valid")).alias("skipped"), count(F.col("ground").isNotNull()).alias("in_grounds"), count(F.col("lod2")).alias("lod2"),
        F.count_distinct(of(F.concat("mesh", "cls"))).alias("tiles"), count(F.col("name") != "").alias("named"), F.count_distinct(of(F.col("cell"))).alias("cells"),
    )


def sidecars(buildings: DataFrame) -> DataFrame:
    """A row of arrays in batch order for each tile: ids, storeys, usage, addresses and ground names."""
    cols = ("id", "s", "u", "addr", "tn")
    rows = F.array_sort(F.collect_list(F.struct("batch_id", *cols)))  # a tile is a square kilometre
    tiles = buildings.groupBy("mesh", "cls").agg(rows.alias("rows"))
    return tiles.select("mesh", "cls", *[F.col("rows")[c].alias(c) for c in cols])


def features_of_sidecars(files: DataFrame) -> DataFrame:
    """A row for each feature of tiles of arrays; missing ground names are empty."""
    tn = F.coalesce("tn", F.transform("id", lambda _: F.lit("")))
    zipped = F.arrays_zip(F.col("id").alias("id"), F.col("s").alias("s"), F.col("u").alias("u"), F.col("addr").alias("addr"), tn.alias("tn"))
    return files.select("mesh", "cls", F.posexplode(zipped).alias("batch_id", "f")).select("mesh", "cls", "batch_id", "f.*")


def manifest(bounds: DataFrame, leaves: bool = False) -> DataFrame:
    """One JSON document over tile bounds (mesh, cls, w, s, e, n, lo, hi): a node for each mesh with its tall tile, its detail below.

    With ``leaves`` (infill), a mesh is one leaf. The document lists the meshes, as its format
    wants, so it is one row of as many nodes as there are square kilometres with buildings.
    """
    sides = {"w": F.min, "s": F.min, "e": F.max, "n": F.max, "lo": F.min, "hi": F.max}
    region = F.array(*sides)
    tile = lambda c, error: F.max(F.when(F.col("cls") == c, F.struct(region.alias("region"), F.concat_ws("_", "mesh", "cls").alias("content"), F.lit(error).alias("geometricError"))))
    per_mesh = bounds.groupBy("mesh").agg(tile("t", 80).alias("t"), tile("d", 0).alias("d"), *[f(k).alias(k) for k, f in sides.items()])
    if leaves:
        node = F.struct("mesh", region.alias("region"), F.lit(0).alias("geometricError"), F.col("mesh").alias("content"))
    else:
        node = F.struct("mesh", region.alias("region"), F.lit(80).alias("geometricError"), F.lit("ADD").alias("refine"), F.col("t").alias("content"), F.col("d").alias("child"))
    whole = per_mesh.agg(F.array_sort(F.collect_list(F.struct("mesh", node.alias("node")))).alias("nodes"), *[f(k).alias(k) for k, f in sides.items()])
    root = F.struct(region.alias("region"), F.lit(2000).alias("geometricError"), F.lit("ADD").alias("refine"), F.transform("nodes", lambda n: n["node"]).alias("children"))
    return whole.select(F.to_json(F.struct(F.lit(5000).alias("geometricError"), root.alias("root"))).alias("manifest"), F.size("nodes").alias("n"))
