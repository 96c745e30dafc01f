"""A store of terrain heights: one row for each chunk of the grid, with the heights of its cells as an array.

A chunk's array has the cells of the chunk and a halo of cells around it, row by row, so
that whatever a point asks for lies in the array of the chunk that the point itself is in.
Looking heights up is then one join on the chunk: points are shuffled once, whether they
ask for one cell, four or twenty-five, and each reads its cells from the array by index,
within generated code. A chunk may hold any share of the points: the join is a plain one,
whose skewed keys AQE splits, repeating one row of heights.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityjobs.functions import geo
from cityjobs.operators.terrain import Grid, coarser
from cityjobs.sources.shared import written

_OWN = ("__cr", "__cc", "__z", "__lo")


@dataclass(frozen=True)
class Heights:
    """Chunks (cr, cc, z, lo) of ``size`` x ``size`` cells with ``halo`` more on every side.

    ``lo`` are the cells of the overview, ``factor`` times as large, of the same area; it is
    null in a store without one. Heights of cells that are missing are null.
    """

    chunks: DataFrame
    grid: Grid
    size: int
    halo: int
    factor: int

    def saved(self, name: str = "heights") -> Heights:
        """The same store, written once to the shared folder."""
        return Heights(written(self.chunks, name), self.grid, self.size, self.halo, self.factor)


def _halo_chunks(at: Column, n: int, size: int, halo: int) -> Column:
    """Chunks in whose rows (or columns) the one at ``at`` lies, the halo included, each with the offset in its array."""
    last = -(-n // size) - 1
    first = F.greatest(F.lit(0), F.floor((at - halo) / size))
    final = F.least(F.lit(last), F.floor((at + halo) / size))
    return F.transform(F.sequence(first.cast("int"), final.cast("int")), lambda k: F.struct(k.alias("chunk"), (at.cast("int") - k * size + halo).alias("off")))


def _arrays(cells: DataFrame, grid: Grid, size: int, halo: int, name: str) -> DataFrame:
    """Rows (cr, cc, ``name``): a group is bounded by the chunk's cells; places without a cell are null."""
    side = size + 2 * halo
    c = cells.withColumn("__r", F.explode(_halo_chunks(F.col("r"), grid.rows, size, halo))).withColumn("__c", F.explode(_halo_chunks(F.col("c"), grid.cols, size, halo)))
    entry = F.struct((F.col("__r.off") * side + F.col("__c.off")).alias("i"), F.col("z").cast("double").alias("z"))
    lists = c.select(F.col("__r.chunk").alias("cr"), F.col("__c.chunk").alias("cc"), entry.alias("x")).groupBy("cr", "cc").agg(F.sort_array(F.collect_list("x")).alias("x"))
    end = F.lit(side * side)
    nulls = lambda n: F.array_repeat(F.lit(None).cast("double"), n)
    filled = F.transform("x", lambda e, k: F.concat(F.array(e["z"]), nulls(F.coalesce(F.get("x", k + 1)["i"], end) - e["i"] - 1)))
    return lists.select("cr", "cc", F.concat(nulls(F.get("x", 0)["i"]), F.flatten(filled)).alias(name))


def height_store(cells: DataFrame, grid: Grid, size: int = 256, halo: int = 2, overview: DataFrame | None = None, factor: int = 4) -> Heights:
    """The store of cells (r, c, z), a row each, and of an overview (r, c, z_dm) if there is one.

    ``halo`` bounds how far from a point's own cell it may ask; 1 for heights between cells.
    """
    if size % factor or halo < 1:
        raise ValueError("a chunk is a whole number of the overview's cells, and has a halo")
    cells = cells.filter(F.col("r").between(0, grid.rows - 1) & F.col("c").between(0, grid.cols - 1))
    chunks = _arrays(cells, grid, size, halo, "z")
    if overview is None:
        return Heights(chunks.withColumn("lo", F.lit(None).cast("array<double>")), grid, size, halo, factor)
    lo = _arrays(overview.select("r", "c", (F.col("z_dm") * F.lit(0.1)).alias("z")), coarser(grid, factor), size // factor, halo, "lo")
    return Heights(chunks.join(lo, ["cr", "cc"], "full"), grid, size, halo, factor)


def _clamped(at: Column, n: int) -> Column:
    return F.when(at.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(n - 1), at)))  # a point without a place has no chunk


def _beside(points: DataFrame, heights: Heights) -> DataFrame:
    """Points (lat, lon) with their row and column of the grid (__r, __c) and the arrays of the chunk that each is in, or nearest to."""
    g = heights.grid
    points = points.withColumns({"__r": g.row(F.col("lat")), "__c": g.col(F.col("lon"))})
    cr = F.floor(_clamped(F.col("__r"), g.rows) / heights.size).cast("int")
    cc = F.floor(_clamped(F.col("__c"), g.cols) / heights.size).cast("int")
    chunks = heights.chunks.select(F.col("cr").alias("__cr"), F.col("cc").alias("__cc"), F.col("z").alias("__z"), F.col("lo").alias("__lo"))
    return points.withColumns({"__cr": cr, "__cc": cc}).join(chunks, ["__cr", "__cc"], "left")


def _cell(heights: Heights, r: Column, c: Column, lo: bool = False) -> Column:
    """The height of a cell of the grid (or the overview) at most a halo away from the point's chunk."""
    size = heights.size // heights.factor if lo else heights.size
    at = (r - F.col("__cr") * size + heights.halo) * (size + 2 * heights.halo) + (c - F.col("__cc") * size + heights.halo)
    return F.get("__lo" if lo else "__z", at.cast("int"))


def _between(heights: Heights, lo: bool) -> tuple[Column, Column]:
    """Height between the four cell centres around a point, missing ones left out; and whether all four are there."""
    g = coarser(heights.grid, heights.factor) if lo else heights.grid
    x = F.greatest(F.lit(0.0), F.least(F.lit(g.cols - 1.0), (F.col("lon") - F.lit(g.west)) / g.res - 0.5))
    y = F.greatest(F.lit(0.0), F.least(F.lit(g.rows - 1.0), (F.lit(g.north) - F.col("lat")) / g.res - 0.5))
    x0, y0 = F.floor(x), F.floor(y)
    fx, fy = x - x0, y - y0
    x1, y1 = F.least(F.lit(g.cols - 1), x0 + 1), F.least(F.lit(g.rows - 1), y0 + 1)
    corners = [(_cell(heights, r, c, lo), w) for r, c, w in ((y0, x0, (1 - fx) * (1 - fy)), (y0, x1, fx * (1 - fy)), (y1, x0, (1 - fx) * fy), (y1, x1, fx * fy))]
    total, whole = F.lit(0.0), F.lit(True)
    for z, w in corners:
        total, whole = total + F.coalesce(w * z, F.lit(0.0)), whole & z.isNotNull()
    return total, whole


def nearest_height(points: DataFrame, heights: Heights) -> DataFrame:
    """Points (lat, lon) with ``ground``, the height of their cell in tenths; the border cell outside, null where there is none."""
    g = heights.grid
    out = _beside(points, heights)
    z = _cell(heights, _clamped(F.col("__r"), g.rows), _clamped(F.col("__c"), g.cols))
    return out.select(*points.columns, F.when(z.isNotNull(), geo.clamped_steps(z, 0.1) * F.lit(0.1)).alias("ground"))


def bilinear_height(points: DataFrame, heights: Heights, out: str = "height") -> DataFrame:
    """Points with the height between the four cell centres around them; 0 outside the grid."""
    total, _ = _between(heights, False)
    return _beside(points, heights).select(*points.columns, F.when(heights.grid.has(F.col("lat"), F.col("lon")), total).otherwise(0.0).alias(out))


def bilinear_with_fallback(points: DataFrame, heights: Heights, use_full: Column | None = None) -> DataFrame:
    """Points with ``height`` from the full cells where all four are there (and ``use_full`` holds, if given), and from the
    overview elsewhere; 0 outside the grid. Both lie in the same chunk, so this is one join as well."""
    (full, whole), (rough, _) = _between(heights, False), _between(heights, True)
    fine = whole if use_full is None else whole & use_full
    height = F.when(~heights.grid.has(F.col("lat"), F.col("lon")), 0.0).when(fine, full).otherwise(rough)
    return _beside(points, heights).select(*points.columns, F.coalesce(height, F.lit(0.0)).alias("height"))


def highest_around(points: DataFrame, heights: Heights, reach: int = 2) -> DataFrame:
    """Points with the highest cell (hr, hc, hz) within +-reach cells, the first in row order of equals."""
    if reach > heights.halo:
        raise ValueError("the halo of the store is smaller than the reach")
    g = heights.grid
    # far outside, the border cells nearest to the point
    around = lambda at, n: F.array_distinct(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda o: _clamped(F.col(at) + o, n)))
    cell = lambda r, c: F.struct(_cell(heights, r, c).alias("z"), (-r).alias("nr"), (-c).alias("nc"))
    cells = F.flatten(F.transform(around("__r", g.rows), lambda r: F.transform(around("__c", g.cols), lambda c: cell(r, c))))
    best = _beside(points, heights).select(*points.columns, F.array_max(cells).alias("__b"))
    found = lambda c: F.when(F.col("__b.z").isNotNull(), c)
    return best.select(*points.columns, found(-F.col("__b.nr")).alias("hr"), found(-F.col("__b.nc")).alias("hc"), F.col("__b.z").alias("hz"))


def lowest_under(rings: DataFrame, heights: Heights, key: str) -> DataFrame:
    """Lowest ground under the vertices of each ring (key, ring)."""
    v = rings.select(key, F.explode("ring").alias("p")).select(key, F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))
    return nearest_height(v, heights).groupBy(key).agg(F.min("ground").alias("ground"))
