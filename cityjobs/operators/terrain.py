"""Terrain grids as tables of cells (r, c, z): correction, overrides, overviews and chunks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityjobs.functions import geo


@dataclass(frozen=True)
class Grid:
    """A grid of cells of ``res`` degrees; row 0 is the northernmost."""

    north: float
    west: float
    res: float
    rows: int
    cols: int

    def row(self, lat: Column) -> Column:
        return F.floor((F.lit(self.north) - lat) / self.res)

    def col(self, lon: Column) -> Column:
        return F.floor((lon - F.lit(self.west)) / self.res)

    def has(self, lat: Column, lon: Column) -> Column:
        return lat.between(self.north - self.rows * self.res, self.north) & lon.between(self.west, self.west + self.cols * self.res)


def base_heights(dem: DataFrame) -> DataFrame:
    """Cells (r, c, z) of raw heights: no data is sea level, and nothing lies under -5."""
    return dem.select("r", "c", F.when(F.col("raw") == -32768, 0.0).otherwise(F.greatest(F.col("raw"), F.lit(-5))).cast("double").alias("z"))


def mean_of_vertices(vertices: DataFrame, grid: Grid) -> DataFrame:
    """Mean height and number of vertices (lat, lon, z) of each cell; vertices outside the grid are left out."""
    at = vertices.select(grid.row(F.col("lat")).alias("r"), grid.col(F.col("lon")).alias("c"), "z")
    at = at.filter(F.col("r").between(0, grid.rows - 1) & F.col("c").between(0, grid.cols - 1))
    return at.groupBy("r", "c").agg(F.avg("z").alias("z"), F.count(F.lit(1)).alias("n"))


def upper_median(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at half the count of each group's sorted values: the upper of two middle ones."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1
    ranked = samples.select(*keys, value, at.alias("__at"), n.alias("__n"))
    return ranked.filter(F.col("__at") == F.floor(F.col("__n") / 2)).select(*keys, F.col(value).alias("median"), F.col("__n").alias("n"))


def smoothing_weight(i: Column, j: Column, n: int, reach: int = 3) -> Column:
    """Ways in which two box sums of +-reach, cut off at 0 and n - 1, lead from cell i to cell j."""
    return F.greatest(F.lit(0), F.least(i + reach, j + reach, F.lit(n - 1)) - F.greatest(i - reach, j - reach, F.lit(0)) + 1)


def corrected(dem: DataFrame, samples: DataFrame, grid: Grid, reach: int = 3, full_weight: float = 20.0) -> DataFrame:
    """Cells with ``z`` moved by the smoothed differences of the samples (r, c, s) from it, and ``delta``.

    Differences and counts go through two box sums each. The two sums together have a
    closed form per axis, so every sampled cell adds weighted parts to the cells around it
    and one aggregation sums them up; cells without samples near are not touched.
    """
    diff = samples.join(dem, ["r", "c"]).groupBy("r", "c").agg(F.sum(F.col("s") - F.col("z")).alias("d"), F.count(F.lit(1)).alias("k"))
    span = F.sequence(F.lit(-2 * reach), F.lit(2 * reach))
    near = diff.withColumn("nr", F.explode(F.transform(span, lambda o: F.col("r") + o))).filter(F.col("nr").between(0, grid.rows - 1))
    near = near.withColumn("nc", F.explode(F.transform(span, lambda o: F.col("c") + o))).filter(F.col("nc").between(0, grid.cols - 1))
    w = smoothing_weight(F.col("r"), F.col("nr"), grid.rows, reach) * smoothing_weight(F.col("c"), F.col("nc"), grid.cols, reach)
    sums = near.groupBy(F.col("nr").alias("r"), F.col("nc").alias("c")).agg(F.sum(w * F.col("d")).alias("sd"), F.sum(w * F.col("k")).alias("sk"))
    delta = F.when(F.col("sk") > 0, F.col("sd") / F.col("sk") * F.least(F.lit(1.0), F.col("sk") / full_weight)).otherwise(0.0)
    return dem.join(sums, ["r", "c"], "left").select("r", "c", (F.col("z") + delta).alias("z"), delta.alias("delta"))


def box_sum(cells: DataFrame, value: str, reach: int = 3) -> DataFrame:
    """Sum of a value over +-reach rows and columns (r, c), nothing beyond the borders."""
    rows = cells.withColumn("__s", F.sum(value).over(Window.partitionBy("r").orderBy("c").rangeBetween(-reach, reach)))
    return rows.select("r", "c", F.sum("__s").over(Window.partitionBy("c").orderBy("r").rangeBetween(-reach, reach)).alias(value))


def overridden(dem: DataFrame, means: DataFrame) -> DataFrame:
    """Cells with the mean of the terrain vertices where there is one, and whether there was."""
    m = means.select("r", "c", F.col("z").alias("__tin"))
    return dem.join(m, ["r", "c"], "left").select("r", "c", F.coalesce("__tin", "z").alias("z"), F.col("__tin").isNotNull().alias("overridden"))


def overview(dem: DataFrame, factor: int = 4) -> DataFrame:
    """Decimetre means of blocks of factor x factor cells; border blocks take what there is."""
    blocks = dem.groupBy(F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.avg("z").alias("z"))
    return blocks.select("r", "c", geo.clamped_steps(F.col("z"), 0.1).alias("z_dm"))


def chunked(dem: DataFrame, grid: Grid, size: int) -> DataFrame:
    """Rows (cr, cc, y, x, z_dm): chunks of (size + 1)^2 cells that share a row and a column with the next.

    Beyond the grid's last row and column the nearest cell is repeated.
    """

    def places(at: Column, n: int) -> Column:
        n_chunks = -(-n // size)
        own = F.floor(at / size)
        one = F.array(F.struct(own.alias("chunk"), (at % size).alias("off")))
        before = F.when((at % size == 0) & (own > 0), F.array(F.struct((own - 1).alias("chunk"), F.lit(size).cast("long").alias("off")))).otherwise(F.slice(one, 1, 0))
        fill = F.when(at == n - 1, F.transform(F.sequence(F.lit(n - (n_chunks - 1) * size).cast("long"), F.lit(size).cast("long")), lambda o: F.struct(F.lit(n_chunks - 1).cast("long").alias("chunk"), o.alias("off"))))
        return F.concat(one, before, F.coalesce(fill, F.slice(one, 1, 0)))

    out = dem.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "z")
    out = out.withColumn("pr", F.explode(places(F.col("r"), grid.rows))).withColumn("pc", F.explode(places(F.col("c"), grid.cols)))
    return out.select(F.col("pr.chunk").alias("cr"), F.col("pc.chunk").alias("cc"), F.col("pr.off").alias("y"), F.col("pc.off").alias("x"), geo.clamped_steps(F.col("z"), 0.1).alias("z_dm"))


def chunk_blobs(cells: DataFrame, size: int) -> DataFrame:
    """A row (name, content) for each chunk of (cr, cc, y, x, z_dm): little-endian 16-bit heights row by row. A chunk is bounded by its size."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((size + 1, size + 1), "<i2")
        out[pdf["y"], pdf["x"]] = pdf["z_dm"]
        return pd.DataFrame({"name": [f"c_{pdf['cr'].iloc[0]}_{pdf['cc'].iloc[0]}.bin"], "content": [out.tobytes()]})

    return cells.groupBy("cr", "cc").applyInPandas(pack, "name string, content binary")


def grid_meta(spark: SparkSession, grid: Grid, factor: int, size: int) -> DataFrame:
    """One row that describes the written terrain."""
    lo = coarser(grid, factor)
    row = (grid.cols, grid.rows, grid.west, grid.north, grid.res, 0.1, (factor, lo.cols, lo.rows), (size, -(-grid.rows // size), -(-grid.cols // size)))
    return spark.createDataFrame([row], "width int, height int, west double, north double, res double, scale double, overview struct<factor:int,width:int,height:int>, chunk struct<size:int,rows:int,cols:int>")


def coarser(grid: Grid, factor: int = 4) -> Grid:
    """The grid of the overview."""
    return Grid(grid.north, grid.west, grid.res * factor, -(-grid.rows // factor), -(-grid.cols // factor))


def coverage(dem: DataFrame, means: DataFrame) -> DataFrame:
    """Number of cells, of cells with terrain vertices, and of cells these override."""
    return overridden(dem, means).agg(F.count(F.lit(1)).alias("cells"), F.count_if("overridden").alias("overridden"))


def tile_samples(tiles: DataFrame, side: int = 33) -> DataFrame:
    """Sample points of tiles (level, x, y) of the geographic scheme: side x side from the north-west, edges included."""
    size = 180.0 / F.pow(F.lit(2.0), F.col("level"))
    t = tiles.withColumns({"west": -180 + F.col("x") * size, "north": 90 - F.col("y") * size, "step": size / (side - 1)})
    t = t.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    return t.select("level", "x", "y", "j", "i", "step", (F.col("north") - F.col("j") * F.col("step")).alias("lat"), (F.col("west") + F.col("i") * F.col("step")).alias("lon"))
