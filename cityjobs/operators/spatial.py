"""Spatial joins as equi-joins on the cells of a quadtree that fits the points.

A histogram of the points decides the cells: level 0 has cells of a given size, and a cell
with more than ``CAPACITY`` points is split into four, down to ``DEPTH`` levels. A point
carries the one leaf that it is in. An area is placed at the level of its own size, so that
it touches four cells at most however large it is: a small one in cells of level 0, from
where it goes down to the leaves, a large one in the larger cells of a level above, for
which points carry a second cell. Cells that are still too full are dealt out in shares,
with their areas in each. The exact test runs on what meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityjobs.functions import geo
from cityjobs.sources.shared import written

#: Points of a cell beyond which it is split, and levels of splitting.
CAPACITY = 4096
DEPTH = 6
#: Points of a cell that cannot be split beyond which they are dealt out in shares.
SHARE = 65_536
#: Full cells up to which they stand in the plan itself; where there are more, they are a table.
LISTED = 2000
_KEY = ["__lv", "__y", "__x", "__share"]
_MARK = 1000


def cell_of(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def with_cells(df: DataFrame, s: Column, w: Column, n: Column, e: Column, size: float) -> DataFrame:
    """A row of ``df`` for each grid cell that the box touches, in columns cy and cx; for boxes of a bounded number of cells."""
    out = df.withColumn("cy", F.explode(F.sequence(cell_of(s, size), cell_of(n, size))))
    return out.withColumn("cx", F.explode(F.sequence(cell_of(w, size), cell_of(e, size))))


@dataclass(frozen=True)
class Tree:
    """Cells of ``size`` degrees at level 0. ``above`` are the levels above (negative) at which there are areas, ``total``
    the number of points, ``listed`` the cells (lv, y, x, n) with more points than ``capacity``, or ``full`` their table."""

    size: float
    capacity: int
    depth: int
    share: int
    above: tuple[int, ...] = ()
    total: int = 0
    listed: tuple[tuple[int, int, int, int], ...] | None = ()
    full: DataFrame | None = None

    def fine(self, x: Column) -> Column:
        """Number of the finest cell; those of all other levels follow from it."""
        return F.floor(x / (self.size / 2**self.depth)).cast("long")

    def at(self, fine: str, level: int | Column) -> Column:
        """Number of the cell of a level that a finest cell lies in."""
        if isinstance(level, int):
            return F.shiftright(F.col(fine), self.depth - level)
        return F.call_function("shiftright", F.col(fine), (F.lit(self.depth) - level).cast("int"))  # a power for each row would cost more than the rest

    def boxed(self, areas: DataFrame) -> DataFrame:
        """Areas with their box in finest cells, and the level at which it touches two cells at most along each axis."""
        a = areas.withColumns({f"__{k}": self.fine(F.col(k)) for k in "swne"})
        span = F.greatest(F.col("__n") - F.col("__s"), F.col("__e") - F.col("__w"))
        return a.withColumn("__lv", F.when(span <= 2**self.depth, F.lit(0)).otherwise(self.depth - F.ceil(F.log2(span.cast("double")))).cast("int"))

    def deepest(self) -> int:
        """The level down to which cells are split, as far as that is known."""
        return self.depth if self.listed is None else max((lv + 1 for lv, *_ in self.listed if 0 <= lv < self.depth), default=0)

    def cells(self, columns: str, rows: list[tuple[int, ...]]) -> DataFrame:
        """A small table within the plan."""
        import pyspark.sql

        spark = pyspark.sql.SparkSession.getActiveSession()
        return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(f'{v}L' for v in r) + ')' for r in rows)} AS t({columns})")

    def leaves(self) -> list[tuple[int, ...]]:
        """(y0, x0, lv, y, x): the leaves below the full cells (y0, x0) of level 0."""
        split = {(lv, y, x) for lv, y, x, _ in self.listed if 0 <= lv < self.depth}
        kids = {(lv + 1, 2 * y + i, 2 * x + j) for lv, y, x in split for i in (0, 1) for j in (0, 1)}
        return [(y >> lv, x >> lv, lv, y, x) for lv, y, x in sorted(kids - split)]


def _cell_number(y: Column, x: Column) -> Column:
    return F.shiftleft(y, 32).bitwiseXOR(x.bitwiseAND(F.lit(0xFFFFFFFF)))


def _cell_number_of(y: int, x: int) -> int:
    return (y << 32) ^ (x & 0xFFFFFFFF)


def tree_of(points: DataFrame, areas: DataFrame, size: float, capacity: int = CAPACITY, depth: int = DEPTH, share: int = SHARE) -> Tree:
    """The tree for points (lat, lon) and areas with boxes (s, w, n, e), from histograms of the points that are combined in the tasks.

    The cells of level 0 are counted first, then, a level at a time, only those within full ones.
    """
    plain = Tree(size, capacity, depth, share)
    cells = points.select(plain.fine(F.col("lat")).alias("fy"), plain.fine(F.col("lon")).alias("fx")).filter("fy IS NOT NULL AND fx IS NOT NULL")
    zero = F.lit(0).cast("long")
    count = lambda of, k: of.groupBy(plain.at("fy", k).alias("y"), plain.at("fx", k).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    counts = count(cells, 0)
    whole = F.struct(F.lit(_MARK).alias("lv"), zero.alias("y"), zero.alias("x"))
    sums = counts.select("n", F.explode(F.array(whole, F.struct(F.lit(0).alias("lv"), "y", "x"))).alias("c")).groupBy("c.lv", "c.y", "c.x").agg(F.sum("n").alias("n"))
    full = sums.filter((F.col("n") > capacity) | (F.col("lv") == _MARK))
    levels = plain.boxed(areas.select(*"swne")).filter("__lv < 0").select((F.col("__lv") + _MARK).alias("lv"), zero.alias("y"), zero.alias("x"), zero.alias("n")).distinct()  # one for each doubling of the size
    few = list(map(tuple, levels.unionByName(full).limit(LISTED + 1).collect()))
    within = cells
    for k in range(depth):
        last = [(y, x) for lv, y, x, _ in few if lv == k]
        if not last or len(few) > LISTED:
            break
        crowded = _cell_number(plain.at("fy", k), plain.at("fx", k)).isin(*(_cell_number_of(*c) for c in last))
        within = within.filter(crowded) if k else written(within.filter(crowded), "crowded")
        below = count(within, k + 1).filter(F.col("n") > capacity).select(F.lit(k + 1).alias("lv"), "y", "x", "n")
        few += map(tuple, below.limit(LISTED + 1).collect())
    if len(few) <= LISTED:
        above = tuple(sorted(lv - _MARK for lv, *_ in few if depth < lv < _MARK))
        total = sum(n for lv, _, _, n in few if lv == _MARK)
        return Tree(size, capacity, depth, share, above, total, tuple(r for r in few if r[0] <= depth))
    finest = cells.groupBy("fy", "fx").agg(F.count(F.lit(1)).alias("n"))
    cell = lambda k: F.struct(F.lit(k).alias("lv"), plain.at("fy", k).alias("y"), plain.at("fx", k).alias("x"))
    sums = finest.select("n", F.explode(F.array(whole, *[cell(k) for k in range(depth + 1)])).alias("c")).groupBy("c.lv", "c.y", "c.x").agg(F.sum("n").alias("n"))
    table = written(levels.unionByName(sums.filter((F.col("n") > capacity) | (F.col("lv") == _MARK))), "full-cells")
    above = tuple(sorted(r["lv"] - _MARK for r in table.filter(F.col("lv").between(depth + 1, _MARK - 1)).collect()))
    total = sum(r["n"] for r in table.filter(F.col("lv") == _MARK).collect())
    return Tree(size, capacity, depth, share, above, total, None, table.filter(F.col("lv") <= depth))


def _shares(keyed: DataFrame, tree: Tree) -> DataFrame:
    """Rows with ``__shares``, into how many their cell is dealt: one unless it is not split and holds too many points."""
    of_above = max(1, -(-tree.total // tree.share))
    crowded = F.col("n") > tree.share
    if tree.listed is None:
        last = tree.full.filter((F.col("lv") == tree.depth) & crowded)
    else:
        rows = [r for r in tree.listed if r[0] == tree.depth and r[3] > tree.share]
        last = tree.cells("lv, y, x, n", rows) if rows else None
    shares = F.lit(1)
    if last is not None:
        of = last.select(F.col("lv").alias("__flv"), F.col("y").alias("__fcy"), F.col("x").alias("__fcx"), F.ceil(F.col("n") / tree.share).cast("int").alias("__times"))
        keyed = keyed.join(of, (F.col("__lv") == F.col("__flv")) & (F.col("__y") == F.col("__fcy")) & (F.col("__x") == F.col("__fcx")), "left")
        shares = F.coalesce("__times", F.lit(1))
    return keyed.withColumn("__shares", F.when(F.col("__lv") < 0, of_above).otherwise(shares))


def keyed_points(points: DataFrame, tree: Tree) -> DataFrame:
    """Points (lat, lon) with the key of their leaf, and a row more for each level above that has areas; those without a place go."""
    p = points.withColumns({"__fy": tree.fine(F.col("lat")), "__fx": tree.fine(F.col("lon"))}).filter("__fy IS NOT NULL AND __fx IS NOT NULL")
    leaf = F.lit(0)
    for k in range(tree.deepest()):  # a cell is only full if those above it are
        if tree.listed is None:
            here = tree.full.filter(F.col("lv") == k).select(F.col("y").alias("__sy"), F.col("x").alias("__sx"), F.lit(1).alias(f"__full{k}"))
            p = p.join(here, (tree.at("__fy", k) == F.col("__sy")) & (tree.at("__fx", k) == F.col("__sx")), "left").drop("__sy", "__sx")
            leaf = leaf + F.coalesce(f"__full{k}", F.lit(0))
        else:
            cells = [_cell_number_of(y, x) for lv, y, x, _ in tree.listed if lv == k]
            leaf = leaf + _cell_number(tree.at("__fy", k), tree.at("__fx", k)).isin(*cells).cast("int")
    key = lambda level: F.struct(level.cast("int").alias("lv"), tree.at("__fy", level).alias("y"), tree.at("__fx", level).alias("x"))
    p = p.withColumn("__leaf", leaf).select(*points.columns, F.explode(F.array(key(F.col("__leaf")), *[key(F.lit(k)) for k in tree.above])).alias("__k"))
    p = _shares(p.select(*points.columns, F.col("__k.lv").alias("__lv"), F.col("__k.y").alias("__y"), F.col("__k.x").alias("__x")), tree)
    hashed = [c for c, t in points.dtypes if "map<" not in t and "variant" not in t]
    return p.select(*points.columns, "__lv", "__y", "__x", F.pmod(F.xxhash64(*hashed), F.col("__shares").cast("long")).cast("int").alias("__share"))


def keyed_boxes(areas: DataFrame, tree: Tree) -> DataFrame:
    """Areas with a row for each leaf that their box (s, w, n, e) touches, or for each of the four cells at most of a level above."""
    span = lambda a, b, level: F.sequence(tree.at(a, level), tree.at(b, level))
    box = ["__s", "__w", "__n", "__e"]
    a = tree.boxed(areas).withColumn("__y", F.explode(span("__s", "__n", F.col("__lv"))))
    a = a.withColumn("__x", F.explode(span("__w", "__e", F.col("__lv"))))
    if tree.listed is not None and tree.deepest():
        below = tree.cells("y0, x0, l, ly, lx", tree.leaves())
        a = a.join(below, (F.col("__lv") == 0) & (F.col("__y") == F.col("y0")) & (F.col("__x") == F.col("x0")), "left")
        touches = lambda c, lo, hi: F.col(c).between(tree.at(lo, F.col("l")), tree.at(hi, F.col("l")))
        a = a.filter(F.col("l").isNull() | (touches("ly", "__s", "__n") & touches("lx", "__w", "__e")))
        a = a.select(*areas.columns, F.coalesce("l", "__lv").cast("int").alias("__lv"), F.coalesce("ly", "__y").alias("__y"), F.coalesce("lx", "__x").alias("__x"))
    for k in range(tree.depth if tree.listed is None else 0):
        here = tree.full.filter(F.col("lv") == k).select(F.lit(k).alias("__lv"), F.col("y").alias("__y"), F.col("x").alias("__x"), F.lit(1).alias("__split"))
        inner = lambda lo, hi, at: F.sequence(F.greatest(tree.at(lo, k + 1), 2 * F.col(at)), F.least(tree.at(hi, k + 1), 2 * F.col(at) + 1))  # noqa: B023, E731
        cells = lambda lo, hi, at: F.when(F.col("__split") == 1, inner(lo, hi, at)).otherwise(F.array(at))
        a = a.join(here, ["__lv", "__y", "__x"], "left").select(*areas.columns, *box, (F.col("__lv") + F.coalesce("__split", F.lit(0))).alias("__lv"), F.explode(cells("__s", "__n", "__y")).alias("__ny"), cells("__w", "__e", "__x").alias("__xs"))
        a = a.select(*areas.columns, *box, "__lv", F.col("__ny").alias("__y"), F.explode("__xs").alias("__x"))
    a = _shares(a, tree)
    return a.select(*areas.columns, "__lv", "__y", "__x", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1)).alias("__share"))


def _in_box() -> Column:
    return F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e"))


def points_in_boxes(points: DataFrame, areas: DataFrame, size: float, tree: Tree | None = None) -> DataFrame:
    """Pairs of a point (lat, lon) and an area whose box (s, w, n, e) holds it, borders included; each pair once."""
    tree = tree or tree_of(points, areas, size)
    return keyed_points(points, tree).join(keyed_boxes(areas, tree), _KEY).filter(_in_box()).drop(*_KEY)


def _meets(left: DataFrame, right: DataFrame, test: Column) -> DataFrame:
    """Rows of ``left`` that meet one of ``right`` in a cell, in whose box they are, or the other way round, and pass ``test``: each is let go at its first."""
    r = right.withColumnsRenamed({k: f"{k}_r" for k in _KEY})
    same = F.lit(True)
    for k in _KEY:
        same = same & (F.col(k) == F.col(f"{k}_r"))
    return left.join(r, same & _in_box() & test, "left_semi").drop(*_KEY)


def points_in(points: DataFrame, areas: DataFrame, test: Column, size: float) -> DataFrame:
    """The points (lat, lon) that lie in the box of an area and pass ``test`` with it; a point may come twice. Other columns must differ."""
    tree = tree_of(points, areas, size)
    return _meets(keyed_points(points, tree), keyed_boxes(areas, tree), test)


def areas_with(areas: DataFrame, points: DataFrame, test: Column, size: float) -> DataFrame:
    """The areas in whose box a point (lat, lon) lies that passes ``test`` with them; an area may come for each of its cells."""
    tree = tree_of(points, areas, size)
    return _meets(keyed_boxes(areas, tree), keyed_points(points, tree), test)


def innermost_area(points: DataFrame, areas: DataFrame, size: float = 0.005) -> DataFrame:
    """Points (pid, lat, lon) with ``ground``: of the areas (i, rings, area of all, box) one of whose rings holds the point
    the smallest, the first of equals; else null."""
    slim = areas.select("i", "rings", "area", "s", "w", "n", "e")
    inside = points_in_boxes(points.select("pid", "lat", "lon"), slim, size).filter(geo.in_any_ring(F.col("lat"), F.col("lon"), F.col("rings")))
    best = inside.groupBy("pid").agg(F.min(F.struct("area", "i"))["i"].alias("ground"))
    return points.join(best, "pid", "left")


def _leaf_by_leaf(sides: DataFrame, keys: list[str], order: list[Column], prepare: Callable, judge: Callable, schema: str) -> DataFrame:
    """Rows of ``judge`` for each leaf (``keys``): its points (``__side`` 0) in their order, as ``prepare`` makes them, or None if it has
    none, and its other rows (1) as they come, a batch at a time; only a leaf's points are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                c = batch.column(k)
                c = c.dictionary_encode().indices if pa.types.is_string(c.type) else c
                c = c.to_numpy(zero_copy_only=False)
                new[1:] |= c[1:] != c[:-1]
            side, starts, out = batch.column("__side").to_numpy(zero_copy_only=False), [0, *np.flatnonzero(new).tolist()], []
            for at, to in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                here = tuple(batch.column(k)[at].as_py() for k in keys)
                if here != leaf:
                    leaf, held, ready = here, [], None
                middle = at + int(np.searchsorted(side[at:to], 1))
                if middle > at:
                    held.append(batch.slice(at, middle - at))
                    ready = None
                if to > middle:
                    if ready is None and held:
                        held = pa.Table.from_batches(held).combine_chunks().to_batches()
                        ready = prepare(held[0])
                    out.append(judge(ready, batch.slice(middle, to - middle)))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    # as many tasks even if the rows are few: the work is in what meets
    n = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sides.repartition(n, *keys).sortWithinPartitions(*keys, "__side", *order).mapInArrow(run, schema)


def _doubles(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]


def _nearest_in_leaf(metres: float, keys: list[str]) -> tuple[Callable, Callable]:
    def prepare(points: pa.RecordBatch):
        return *_doubles(points, "lat", "lon"), points.column("seq")

    def judge(points, q: pa.RecordBatch) -> pa.RecordBatch:
        qlat, qlon = _doubles(q, "lat", "lon")
        dist, at = np.full(len(qlat), metres), np.zeros(len(qlat), np.int64)
        if points is not None:
            lat, lon, _ = points
            rows, cols = max(1, (1 << 19) // len(lat)), 1 << 16
            for i in range(0, len(qlat), rows):
                for j in range(0, len(lat), cols):
                    dy, dx = (qlat[i : i + rows, None] - lat[j : j + cols]) * geo.M_LAT, (qlon[i : i + rows, None] - lon[j : j + cols]) * geo.M_LON
                    d = np.sqrt(dy * dy + dx * dx)
                    first = d.argmin(axis=1)  # of equals the first point
                    least = d[np.arange(len(first)), first]
                    nearer = least < dist[i : i + rows]
                    dist[i : i + rows][nearer], at[i : i + rows][nearer] = least[nearer], first[nearer] + j
        met = dist < metres
        seq = points[2].take(pa.array(at, mask=~met)) if points is not None else pa.nulls(len(at), q.column("seq").type)
        return pa.RecordBatch.from_arrays([*(q.column(c) for c in ("qid", "lat", "lon", *keys)), pa.array(dist), seq], names=["qid", "lat", "lon", *keys, "dist", "seq"])

    return prepare, judge


class _Nearest:
    """Points (seq, lat, lon[, key]) in leaves, to look for the nearest one of queries (qid, lat, lon[, key]) under ``metres``; with equal ``key`` if one is given."""

    def __init__(self, points: DataFrame, queries: DataFrame, metres: float, key: str | None, capacity: int):
        real = "NOT isnan(lat) AND NOT isnan(lon)" + (f" AND {key} IS NOT NULL" if key else "")
        self.own = keys = [key] if key else []
        self.metres, self.keys = metres, [*_KEY, *keys]
        self.points = points.select("seq", "lat", "lon", *keys).filter(real)
        self.queries = queries.select("qid", "lat", "lon", *keys).filter(real)
        self.tree = tree_of(self.points, _no_areas(self.points), 2.02 * metres / geo.M_LON, capacity)  # a box of any query is no larger than a cell
        self.types = dict(points.dtypes)["seq"], dict(queries.dtypes)["qid"]
        self.keyed = keyed_points(self.points, self.tree).select(*self.keys, F.lit(0).alias("__side"), "lat", "lon", "seq", F.lit(None).cast(self.types[1]).alias("qid"))

    def _met(self, keyed: DataFrame) -> DataFrame:
        asked = keyed.select(*self.keys, F.lit(1).alias("__side"), "lat", "lon", F.lit(None).cast(self.types[0]).alias("seq"), "qid")
        schema = ", ".join([f"qid {self.types[1]}, lat double, lon double", *(f"{k} string" for k in self.own), f"dist double, seq {self.types[0]}"])
        return _leaf_by_leaf(self.keyed.unionByName(asked), self.keys, [F.col("seq")], *_nearest_in_leaf(self.metres, self.own), schema)

    def at_home(self) -> DataFrame:
        """All queries with a place (qid, lat, lon[, key], dist, seq): the nearest point within their own leaf; none there is one at ``metres``."""
        return self._met(keyed_points(self.queries, self.tree))

    def around(self, queries: DataFrame) -> DataFrame:
        """(qid, dist, seq) of queries (qid, lat, lon[, key], dist) for each leaf with a point nearer than ``metres``, of those that meet the box of ``dist``."""
        dlat, dlon = (F.col("dist") / m * 1.000001 + 1e-9 for m in (geo.M_LAT, geo.M_LON))
        box = queries.withColumns({"s": F.col("lat") - dlat, "n": F.col("lat") + dlat, "w": F.col("lon") - dlon, "e": F.col("lon") + dlon}).drop("dist", "seq")
        return self._met(keyed_boxes(box, self.tree)).filter("seq IS NOT NULL").select("qid", "dist", "seq")


def _no_areas(points: DataFrame) -> DataFrame:
    return points.limit(0).select(*[F.col("lat").alias(k) for k in "swne"])


def nearest_within(queries: DataFrame, points: DataFrame, metres: float, capacity: int = CAPACITY) -> DataFrame:
    """Queries (qid, lat, lon) with ``nearest`` (seq of the point) and ``dist`` under ``metres``; ties go to the first point.

    The nearest point of a query's own leaf tells how far to look: only leaves that lie as
    near are asked then. So what is compared follows the rows, however close the points lie,
    and for each query a row or a few are shuffled.
    """
    n = _Nearest(points, queries, metres, None, capacity)
    met = n.around(n.at_home())
    best = met.groupBy("qid").agg(F.min(F.struct("dist", "seq")).alias("b")).select("qid", F.col("b.seq").alias("nearest"), F.col("b.dist").alias("dist"))
    return queries.join(best, "qid", "left")


def with_one_within(queries: DataFrame, points: DataFrame, metres: float, key: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The ids (qid) of queries (qid, lat, lon) with a point (lat, lon) nearer than ``metres``, of equal ``key`` if one is given; an id may come several times.

    Queries with one in their own leaf are settled; only the others look further.
    """
    n = _Nearest(points.withColumn("seq", F.lit(0)), queries, metres, key, capacity)
    home = written(n.at_home(), "at-home")
    found = n.around(home.filter("seq IS NULL"))
    return home.filter("seq IS NOT NULL").select("qid").unionByName(found.select("qid"))


def tallest_inside(areas: DataFrame, points: DataFrame, size: float = 0.001) -> DataFrame:
    """Areas (i, rings, box) with ``tallest``: seq of the highest point (seq, lat, lon, top) in one of the rings, the first of equals.

    The greatest height of an area is summed in the tasks, from pairs that are neither sorted nor
    shuffled; points of just that height are then looked up again.
    """
    p, a = points.select("seq", "lat", "lon", "top"), areas.select("i", "rings", "s", "w", "n", "e")
    tree = tree_of(p, a, size)
    keyed, boxes = keyed_points(p, tree), keyed_boxes(a, tree)
    inside = geo.in_any_ring(F.col("lat"), F.col("lon"), F.col("rings"))
    high = keyed.join(boxes, _KEY).filter(_in_box()).filter(inside).groupBy("i").agg(F.max("top").alias("__high"))
    of = boxes.join(written(high, "high"), "i").withColumnsRenamed({k: f"{k}_a" for k in _KEY})
    same = F.col("top").eqNullSafe(F.col("__high"))
    for k in _KEY:
        same = same & (F.col(k) == F.col(f"{k}_a"))
    first = keyed.join(of, same).filter(_in_box()).filter(inside).groupBy("i").agg(F.min("seq").alias("tallest"))
    return areas.join(first, "i", "left")


def not_covered(ways: DataFrame, footprints: DataFrame, points: DataFrame, size: float = 0.001) -> DataFrame:
    """Ways (id, lat, lon, ring, box) whose centre is in no footprint (fid, ring, box) and that hold no point (lat, lon)."""
    inside = geo.in_ring(F.col("lat"), F.col("lon"), F.col("ring"))
    centre = points_in(ways.select("id", "lat", "lon"), footprints.select("fid", "ring", "s", "w", "n", "e"), inside, size).select("id")
    holds = areas_with(ways.select("id", "ring", "s", "w", "n", "e"), points.select("lat", "lon"), inside, size).select("id")
    return ways.join(centre.unionByName(holds).distinct(), "id", "left_anti")


def outlines_of_parts(ways: DataFrame, size: float = 0.001) -> DataFrame:
    """Ways that are not parts and hold the centre of a part: their parts are drawn instead."""
    parts = ways.filter("is_part").select(F.col("id").alias("pid"), "lat", "lon")
    outlines = ways.filter("NOT is_part").select("id", "ring", "s", "w", "n", "e")
    inside = (F.col("pid") != F.col("id")) & geo.in_ring(F.col("lat"), F.col("lon"), F.col("ring"))
    return ways.join(areas_with(outlines, parts, inside, size).select("id").distinct(), "id", "left_semi")


def close_pairs(left: DataFrame, right: DataFrame, metres: float, key: str | None = None) -> DataFrame:
    """Pairs of left (lid, lat, lon, ...) and right (rid, rlat, rlon, ...) closer than ``metres``; with equal ``key`` if one is given."""
    size = metres / geo.M_LON
    l = left.withColumns({"cy": cell_of(F.col("lat"), size), "cx": cell_of(F.col("lon"), size)})
    r = with_cells(right, F.col("rlat") - size, F.col("rlon") - size, F.col("rlat") + size, F.col("rlon") + size, size)
    both = l.join(r, ["cy", "cx"] + ([key] if key else [])).drop("cy", "cx")
    return both.filter(geo.plane_distance(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")) < metres)


def all_close_pairs(left: DataFrame, right: DataFrame, metres: float, test: Column, key: str | None = None) -> DataFrame:
    """The same pairs, those that pass ``test`` as well, where they may be many more than the rows: no task has more than a leaf's rows of ``left``
    (without ``key`` of its own, columns of both sides differ), and no pair is shuffled."""
    reach = metres / geo.M_LON * 1.000001  # the longer of a metre's degrees
    boxes = right.withColumns({"s": F.col("rlat") - reach, "n": F.col("rlat") + reach, "w": F.col("rlon") - reach, "e": F.col("rlon") + reach})
    tree = tree_of(left, _no_areas(left), 2.02 * metres / geo.M_LON)  # a box is no larger than a cell
    keys = _KEY + ([key] if key else [])
    # so many tasks even if the rows are few: the work is in their pairs
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l, r = (d.repartition(n, *keys) for d in (keyed_points(left, tree), keyed_boxes(boxes, tree).drop(*"swne")))
    near = geo.plane_distance(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")) < metres
    return l.join(r.hint("merge"), keys).filter(test & near).drop(*_KEY)
