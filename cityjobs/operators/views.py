"""What a viewpoint sees: label candidates, line of sight over terrain, decluttering, and view texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityjobs.functions import geo
from cityjobs.operators.heights import Heights, bilinear_height
from cityjobs.operators.terrain import Grid
from cityjobs.sources.shared import written

# fixed values: greatest distance in metres by kind and rank; names of compass points; usage codes; colours
MAX_DISTANCE = {"p": (160000, 50000, 12000), "t": (60000, 15000, 4500), "l": (45000, 12000, 3500), "s": (8000, 6000, 3000), "f": (6000, 4000, 1500)}
POINTS_8 = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
POINTS_16 = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
USAGE = {
    "401": "Office", "402": "Commercial", "403": "Accommodation", "404": "Mixed commercial", "411": "House", "412": "Apartment", "413": "House with shop", "414": "Apartment with shops",
    "415": "House with workshop", "421": "Government", "422": "Education / welfare", "431": "Transport / warehouse", "441": "Factory", "451": "Agriculture / fishery", "452": "Utility",
    "453": "Defence", "454": "Other", "461": "Unknown",
}
COLOURS = ("#c9874f", "#e2583e", "#b9a3d6", "#6fa58c", "#ffe2b0", "#dfe8f5", "#f3f0ea")
# end of fixed values


def candidates(views: DataFrame, labels: DataFrame, kinds: tuple[str, ...] = tuple(MAX_DISTANCE)) -> DataFrame:
    """Pairs of a view (view_id, vlat, vlon, vh, heading, pitch) and a label (id, k, r, lat, lon, z) in front of it and near enough, with ``dist``.

    Labels lie in cells of the greatest distance of their kind and rank; a view asks for the
    cells that its box of that distance meets, wider in longitude the further from the equator,
    and across the 180th meridian.
    """
    rows = [F.struct(F.lit(k).alias("k"), F.lit(i + 1).alias("r"), F.lit(float(m)).alias("most")) for k in kinds for i, m in enumerate(MAX_DISTANCE[k])]
    limits = labels.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.k", "x.r", "x.most")  # 15 rows
    size = F.col("most") / 100000.0  # degrees; a degree of latitude is 110.5 km at least
    around = F.floor(F.lit(360.0) / size)  # cells to the east go from 0 to this
    east = lambda lon: F.pmod(lon + 180.0, F.lit(360.0))
    near = labels.join(F.broadcast(limits), ["k", "r"])
    near = near.withColumns({"cy": F.floor(F.col("lat") / size), "cx": F.floor(east(F.col("lon")) / size)})
    most = limits.select("most").distinct()
    v = views.join(F.broadcast(most), F.lit(True))  # 15 distances at most
    wide = F.least(F.lit(180.0), size / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.abs("vlat") + size)))))
    v = v.withColumn("cy", F.explode(F.sequence(F.floor((F.col("vlat") - size) / size), F.floor((F.col("vlat") + size) / size))))
    v = v.withColumn("cx", F.explode(F.sequence(F.floor((east(F.col("vlon")) - wide) / size), F.floor((east(F.col("vlon")) + wide) / size))))
    # beyond the meridian cells go on from the other side, whose last cell may be a part of one
    other = F.when(F.col("cx") < 0, F.array(F.col("cx") + around, F.col("cx") + around + 1)).when(F.col("cx") >= around, F.array(F.col("cx"), F.col("cx") - around, F.col("cx") - around - 1)).otherwise(F.array("cx"))
    v = v.withColumn("cx", F.explode(other)).distinct()
    both = near.join(v, ["most", "cy", "cx"])
    eye, at = geo.ecef(F.col("vlat"), F.col("vlon"), F.col("vh")), geo.ecef(F.col("lat"), F.col("lon"), F.col("z"))
    dist = F.sqrt(sum(((a - b) * (a - b) for a, b in zip(at, eye, strict=True)), F.lit(0.0)))
    e, n, u = geo.local_enu(F.col("lat"), F.col("lon"), F.col("z"), F.col("vlat"), F.col("vlon"))
    head, pitch = F.radians("heading"), F.radians("pitch")
    front = e * F.sin(head) * F.cos(pitch) + n * F.cos(head) * F.cos(pitch) + (u - F.col("vh")) * F.sin(pitch)
    return both.withColumn("dist", dist).filter((F.col("dist") <= F.col("most")) & (front > 0)).drop("most", "cy", "cx")


def _steps() -> Column:
    return F.greatest(F.lit(8), F.least(F.lit(48), F.floor(F.col("dist") / 400 + 0.5))).cast("int")


def sight_samples(pairs: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Points (pair, i, f, lat, lon, h) on the straight lines of pairs (pair, vlat, vlon, vh, lat, lon, z, dist); all of a line's, or those from ``first`` to ``last``."""
    ends = F.struct(*[c.alias(f"{n}{i}") for n, end in (("a", ("vlat", "vlon", "vh")), ("b", ("lat", "lon", "z"))) for i, c in enumerate(geo.ecef(*map(F.col, end)))])
    steps = _steps()
    first, last = F.lit(1) if first is None else first, steps - 1 if last is None else F.least(last, steps - 1)
    # a generator over one element keeps the planner from writing out the same sums over and over
    p = pairs.select("pair", steps.alias("steps"), first.alias("first"), last.alias("last"), F.explode(F.array(ends)).alias("q"))
    p = p.withColumn("i", F.explode(F.sequence(F.col("first"), F.col("last")))).withColumn("f", F.col("i") / F.col("steps"))
    xyz = F.struct(*[(F.col(f"q.a{i}") + (F.col(f"q.b{i}") - F.col(f"q.a{i}")) * F.col("f")).alias(n) for i, n in enumerate("xyz")])
    p = p.select("pair", "i", "f", F.explode(F.array(xyz)).alias("at"))
    lat, lon, h = geo.geodetic(F.col("at.x"), F.col("at.y"), F.col("at.z"))
    return p.select("pair", "i", "f", lat.alias("lat"), lon.alias("lon"), h.alias("h"))


def _allowed() -> Column:
    """Height of terrain that does not yet hide the line: 3 metres above it, and 8 more towards the label."""
    return F.col("h") + 3 + F.col("f") * 8


#: Samples of a stretch of a line that is judged as one.
STRETCH = 6
#: The finest and the coarsest level of the pyramid of greatest heights; a level's blocks have 2**level cells on a side.
LEVELS = (1, 12)


def height_pyramid(cells: DataFrame) -> DataFrame:
    """Rows (lv, y, x, hi): the greatest height, 0 at least, in each block of 2**lv cells a side of cells (r, c, z) and in the eight around it.

    One sum over the cells for the finest blocks, one over these for all levels.
    """
    half = lambda c, k: F.shiftright(F.col(c).cast("long"), k)
    finest = cells.groupBy(half("r", LEVELS[0]).alias("y"), half("c", LEVELS[0]).alias("x")).agg(F.max(F.greatest(F.lit(0.0), "z")).alias("hi"))
    every = F.array(*[F.struct(F.lit(LEVELS[0] + k).alias("lv"), half("y", k).alias("y"), half("x", k).alias("x")) for k in range(LEVELS[1] - LEVELS[0] + 1)])
    blocks = finest.select("hi", F.explode(every).alias("b")).groupBy("b.lv", "b.y", "b.x").agg(F.max("hi").alias("hi"))
    near = F.array(*[F.struct((F.col("y") + i).alias("y"), (F.col("x") + j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    wide = blocks.select("lv", "hi", F.explode(near).alias("at")).groupBy("lv", "at.y", "at.x").agg(F.max("hi").alias("hi"))
    return written(wide, "pyramid")


def doubtful_stretches(pairs: DataFrame, pyramid: DataFrame, grid: Grid) -> DataFrame:
    """The stretches (pair, first, last, place) of lines that the pyramid does not clear, those with the most terrain above them first.

    A stretch is looked up once, at the level at which its samples, and the cells around
    them, lie within one block of the one its middle is in.
    """
    s = sight_samples(pairs).withColumn("seg", F.floor((F.col("i") - 1) / STRETCH).cast("int"))
    ends = [f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))]
    seg = s.groupBy("pair", "seg").agg(F.min(_allowed()).alias("allowed"), *ends)  # mostly summed before the shuffle: a line's samples lie side by side
    half = F.greatest(F.col("hi_lat") - F.col("lo_lat"), F.col("hi_lon") - F.col("lo_lon")) / (2 * grid.res) + 1.5
    lv = F.greatest(F.lit(LEVELS[0]), F.ceil(F.log2(half))).cast("int")
    middle = lambda c: (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2
    block = lambda at: F.floor(at / F.pow(F.lit(2.0), F.col("lv"))).cast("long")
    seg = seg.withColumn("lv", lv).withColumns({"y": block(grid.row(middle("lat"))), "x": block(grid.col(middle("lon")))})
    known = seg.join(pyramid, ["lv", "y", "x"], "left")
    # outside the grid, and where cells are missing, terrain counts as sea level; a stretch too long for the pyramid stays in doubt
    over = F.when(F.col("lv") <= LEVELS[1], F.coalesce("hi", F.lit(0.0)) - F.col("allowed")).otherwise(F.lit(float("inf")))
    left = known.withColumn("over", over).filter("over > 0")
    place = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("over"), "seg"))  # at most 8 for a line
    return left.select("pair", (F.col("seg") * STRETCH + 1).alias("first"), (F.col("seg") * STRETCH + STRETCH).alias("last"), place.alias("place"))


def in_sight(pairs: DataFrame, heights: Heights, pyramid: DataFrame) -> DataFrame:
    """Pairs (pair, ...) whose line no terrain rises above by more than 3 metres, and 8 more towards the label.

    Stretches that the pyramid clears are not sampled. Of the others the most doubtful one of
    each line is sampled first, and only lines that it leaves open are sampled further.
    """
    slim = written(pairs.select("pair", "vlat", "vlon", "vh", "lat", "lon", "z", "dist"), "lines")
    doubtful = written(doubtful_stretches(slim, pyramid, heights.grid), "stretches")

    def hidden(stretches: DataFrame) -> DataFrame:
        lines = slim.join(stretches, "pair")
        taken = sight_samples(lines, F.col("first"), F.col("last"))
        return bilinear_height(taken, heights).filter(F.col("height") > _allowed()).select("pair").distinct()

    first = written(hidden(doubtful.filter("place = 1")), "hidden")
    second = written(hidden(doubtful.filter("place > 1").join(first, "pair", "left_anti")), "hidden")
    return pairs.join(first.unionByName(second), "pair", "left_anti")


def label_text(kind: Column, name: Column, e: Column) -> Column:
    return F.when((kind == "p") & (F.coalesce(e, F.lit(0)) != 0), F.concat(name, F.lit(" "), e.cast("long").cast("string"), F.lit("m"))).otherwise(name)


def label_box(text: Column, kind: Column, r: Column) -> tuple[Column, Column]:
    """Width and height of a label: a wide letter takes the font size, another 0.58 of it."""
    px = F.get(F.array(F.lit(17), F.lit(15), F.lit(13)), r - 1) - F.when(kind == "f", 1).otherwise(0)
    wide = F.char_length(F.regexp_replace(text, "[^⺁-\U0010ffff]", ""))
    return wide * px + (F.char_length(text) - wide) * px * 0.58 + 8, px * 2.4 + 6


def distance_scale(dist: Column) -> Column:
    return F.when(dist > 2000, F.greatest(F.lit(0.8), 1 - 0.2 * (dist - 2000) / 78000)).otherwise(1.0)


_CORNERS = ("x0", "y0", "x1", "y1")


def _walk(most: int, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The boxes that are taken of rows sorted by view and order; ``__held`` of each view have been taken before, none of them in the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view, held, n = None, [], 0
        for batch in batches:
            views, had = batch.column("view_id").to_pylist(), batch.column("__held").to_numpy(zero_copy_only=False)
            box = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in _CORNERS])
            taken, at = [], 0
            while at < len(views):
                to = len(views) if views[-1] == views[at] else next(i for i in range(at, len(views)) if views[i] != views[at])
                if view is None or views[at] != view[0]:
                    view, held, n = (views[at],), [], int(had[at])
                x0, y0, x1, y1 = box[at:to].T
                meets = lambda b: (x0 < b[2]) & (x1 > b[0]) & (y0 < b[3]) & (y1 > b[1])  # noqa: B023, E731
                free = np.ones(to - at, bool)
                for b in held if n < most else ():
                    free &= ~meets(b)
                while n < most and free.any():
                    i = int(free.argmax())  # the first one that is free
                    b = tuple(box[at + i])
                    free &= ~meets(b)
                    free[: i + 1] = False
                    held.append(b)
                    taken.append(at + i)
                    n += 1
                at = to
            if taken:
                yield batch.take(pa.array(taken)).select(columns)

    return run


def declutter(boxes: DataFrame, most: int = 70, prefix: int = 512) -> DataFrame:
    """Per view, in order (ord, then id), the boxes (x0, y0, x1, y1) in sight (clear) that overlap none taken before; ``most`` at most.

    Of every view the first ``prefix`` boxes of its order are looked at; Spark takes the first
    ones in every task before it shuffles, and what stands behind a full view is never moved.
    Of views that are not full by then, the boxes behind are first rid, where they are, of those
    that overlap a taken one; what is left is walked through in its order, a batch at a time, and
    nothing but the taken boxes is held. Boxes without an order are left out.
    """
    columns = boxes.columns
    # one that is hidden is never taken and is in nobody's way
    boxes = written(boxes.filter("ord IS NOT NULL AND clear"), "boxes")
    walked = lambda d: d.repartition("view_id").sortWithinPartitions("view_id", "ord", "id").mapInArrow(_walk(most, columns), boxes.schema)
    n = F.row_number().over(Window.partitionBy("view_id").orderBy("ord", "id"))
    part = written(boxes.withColumn("__n", n).filter(F.col("__n") <= prefix).drop("__n"), "first-boxes")
    first = written(walked(part.withColumn("__held", F.lit(0))), "taken-first")
    counts = first.groupBy("view_id").agg(F.count(F.lit(1)).alias("__held"), F.collect_list(F.struct(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in _CORNERS])).alias("__taken"))  # most of them at most
    ends = part.groupBy("view_id").agg(F.max(F.struct("ord", "id")).alias("__last"), F.count(F.lit(1)).alias("__seen"))
    ends = written(ends.join(counts, "view_id").filter((F.col("__seen") == prefix) & (F.col("__held") < most)).drop("__seen"), "open-views")
    if ends.isEmpty():
        return first
    number = {c: F.when(~F.isnan(c), F.col(c)) for c in _CORNERS}  # what is no number meets nothing
    meets = lambda b: (number["x0"] < b["x1"]) & (number["x1"] > b["x0"]) & (number["y0"] < b["y1"]) & (number["y1"] > b["y0"])
    behind = boxes.join(ends, "view_id").filter(F.struct("ord", "id") > F.col("__last")).filter(~F.exists("__taken", lambda b: F.coalesce(meets(b), F.lit(False))))
    return first.unionByName(written(walked(behind.drop("__last", "__taken")), "taken"))


def wikipedia_link(ref: Column) -> Column:
    lang, title = F.regexp_extract(ref, "^([a-z-]+):(.+)$", 1), F.regexp_extract(ref, "^([a-z-]+):(.+)$", 2)
    return F.when(lang != "", F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), F.replace(F.url_encode(title), F.lit("+"), F.lit("%20"))))


def colour_class(rel: Column, name: Column, h: Column) -> Column:
    c = F.when(rel == 1, COLOURS[0]).when(rel == 2, COLOURS[1]).when(rel == 3, COLOURS[2]).when(rel == 4, COLOURS[3])
    return c.when(name != "", COLOURS[4]).when(h >= 60, COLOURS[5]).otherwise(COLOURS[6])


def usage_name(buildings: DataFrame) -> DataFrame:
    """Buildings (u) with ``usage``, the name of their usage code, empty if unknown."""
    rows = F.array(*[F.struct(F.lit(k).alias("u"), F.lit(v).alias("usage")) for k, v in USAGE.items()])
    codes = buildings.sparkSession.range(1).select(F.explode(rows).alias("x")).select("x.u", "x.usage")  # 18 rows
    return buildings.join(F.broadcast(codes), "u", "left").withColumn("usage", F.coalesce("usage", F.lit("")))


def display_title(name: Column, ground: Column, usage: Column) -> Column:
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(name), F.concat(F.lit("Building at "), filled(ground)), filled(usage), F.lit("—"))


def place_kind(rel: Column) -> Column:
    """What a ground is: a temple, a shrine, a castle, or another place of worship."""
    return F.when(rel == 1, "Temple").when(rel == 2, "Shrine").when(rel == 4, "Castle").otherwise("Place of worship")


def building_rows(buildings: DataFrame, labels: DataFrame) -> DataFrame:
    """Buildings (pid, name, tn, usage) with what is shown of them: title, and kind and name of their ground where both have one.

    ``labels`` (seq, k, ja, g) tell the ground of a building by its name, the first of equals.
    """
    grounds = labels.filter("k = 't'").groupBy(F.col("ja").alias("tn")).agg(F.min_by("g", "seq").alias("g"))
    b = buildings.join(grounds, "tn", "left")
    shown = (F.coalesce("name", F.lit("")) != "") & (F.coalesce("tn", F.lit("")) != "")
    return b.withColumns({"title": display_title(F.col("name"), F.col("tn"), F.col("usage")), "place_kind": F.when(shown, place_kind(F.col("g"))), "place": F.when(shown, F.col("tn"))})


def view_link(lat: Column, lon: Column, h: Column, heading: Column, pitch: Column, look: Column | None = None, spin: Column | None = None) -> Column:
    """Link of a view; ``look`` for one at eye level, ``spin`` seconds for one that turns."""
    v = F.concat_ws(",", F.format_string("%.6f", lat), F.format_string("%.6f", lon), F.format_string("%.1f", h), F.format_string("%.1f", heading), F.format_string("%.1f", pitch))
    tail = F.when(look, "&look=1").otherwise("") if look is not None else F.lit("")
    turn = F.coalesce(F.concat(F.lit("&spin="), F.regexp_replace(spin.cast("string"), r"\.0$", "")), F.lit("")) if spin is not None else F.lit("")
    return F.concat(F.lit("#v="), v, tail, turn)


def parsed_view(link: Column) -> Column:
    """The five numbers of a view link; null unless there are just five and all are finite."""
    v = F.transform(F.split(F.regexp_extract(link, "[#&]v=([^&]*)", 1), ","), lambda x: x.try_cast("double"))
    good = (F.size(v) == 5) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(good, v)


def view_options(link: Column) -> dict[str, Column]:
    """Whether a link looks from eye level, and the seconds of a turn if it has more than 0."""
    spin = F.regexp_extract(link, "[#&]spin=([^&]*)", 1).try_cast("double")
    return {"look": F.regexp_extract(link, "[#&]look=([^&]*)", 1) == "1", "spin": F.when(spin > 0, spin)}
