"""Greedy selection of places in an order: a place goes if an earlier one that stays is too near.

Places are settled in blocks, the leaves of a quadtree, each with the places around it that
may matter. A block settles in one pass, in order, whatever depends on nothing outside that
is still open; no pairs are ever written, and as places that stay keep their distance, a
crowded block costs no more than its places. What is too near to a new place that stays is
then dropped everywhere, and only what still hangs on places beyond a block's border goes
into another round. So rounds follow the number of borders that a chain of dependent places
crosses, not its length.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityjobs.functions import geo
from cityjobs.operators import spatial as S
from cityjobs.sources.shared import written

#: Open places of a block that are looked at in a round; the rest waits for what these leave.
BLOCK = 20_000


@dataclass(frozen=True)
class Rule:
    """Two places are too near under ``metres``; with ``same_name`` only if their names agree, with ``ending`` only if these end so."""

    metres: float
    same_name: bool = False
    ending: str = ""


class _Taken:
    """Places in cells for each rule, to find whether one is too near to any of them."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.cells: list[dict] = [defaultdict(list) for _ in rules]

    def _keys(self, name: str | None, lat: float, lon: float):
        for rule, cells in zip(self.rules, self.cells, strict=True):
            if (rule.same_name and name is None) or not (name or "").endswith(rule.ending):
                continue
            size = rule.metres * 1.000001
            yield rule.metres, cells, name if rule.same_name else None, math.floor(lat * geo.M_LAT / size), math.floor(lon * geo.M_LON / size)

    def add(self, name: str | None, lat: float, lon: float) -> None:
        for _, cells, n, y, x in self._keys(name, lat, lon):
            cells[n, y, x].append((lat, lon))

    def near(self, name: str | None, lat: float, lon: float) -> bool:
        for metres, cells, n, y, x in self._keys(name, lat, lon):
            for cy in (y - 1, y, y + 1):
                for cx in (x - 1, x, x + 1):
                    for a, b in cells.get((n, cy, cx), ()):
                        dy, dx = (lat - a) * geo.M_LAT, (lon - b) * geo.M_LON
                        if math.sqrt(dy * dy + dx * dx) < metres:
                            return True
        return False


def _settle_block(rules: tuple[Rule, ...]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        upto = pdf["__upto"].min()  # of what is around, all places up to this one are here
        stay, open_ = _Taken(rules), _Taken(rules)
        ids, flags = [], []
        for i, name, lat, lon, home in zip(pdf["id"], pdf["name"], pdf["lat"], pdf["lon"], pdf["__home"], strict=True):
            if i > upto:
                break
            name = name if isinstance(name, str) else None
            gone = stay.near(name, lat, lon)
            sure = home and not gone and not open_.near(name, lat, lon)
            if not gone:
                (stay if sure else open_).add(name, lat, lon)
            if home and (gone or sure):
                ids.append(i)
                flags.append(sure)
        return pd.DataFrame({"id": np.array(ids, np.int64), "stays": np.array(flags, bool)})

    return run


def too_near(places: DataFrame, taken: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ids of the places (id, name, lat, lon) that a rule keeps apart from a taken one (name, lat, lon); one may come several times."""
    out = []
    right = taken.select("name", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    for rule in rules:
        p, t = (d.filter(F.col("name").endswith(rule.ending)) if rule.ending else d for d in (places, right))
        near = S.close_pairs(p.select("id", "name", "lat", "lon"), t, rule.metres, "name") if rule.same_name else S.close_pairs(p.select("id", "lat", "lon"), t.drop("name"), rule.metres)
        out.append(near.select("id"))
    return reduce(DataFrame.unionByName, out)


def _blocks(open_: DataFrame, reach: float, block: int) -> DataFrame:
    """Open places with a row for each block that they may matter to (__lv, __y, __x), whether it is their own (__home), and __upto."""
    tree = S.tree_of(open_, open_.limit(0).select(*[F.col("lat").alias(k) for k in "swne"]), 8 * reach, block, 2, share=1 << 62)  # no shares: a block is one
    if tree.listed is None:
        crowded = not tree.full.filter(F.col("lv") == tree.depth).isEmpty()
    else:
        crowded = any(lv == tree.depth for lv, *_ in tree.listed)
    if not crowded:
        part = open_.withColumn("__upto", F.lit((1 << 63) - 1))
    else:
        # of a block with more places the first ones; Spark takes the first of every task before it shuffles
        key = ["__lv", "__y", "__x"]
        homes = written(S.keyed_points(open_, tree).drop("__share"), "homes")
        first = homes.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).filter(F.col("__n") <= block)
        counts = homes.groupBy(*key).agg(F.count(F.lit(1)).alias("__all"))
        last = first.groupBy(*key).agg(F.max("id").alias("__last"), F.count(F.lit(1)).alias("__here")).join(counts, key)
        part = first.join(last.select(*key, F.when(F.col("__here") < F.col("__all"), F.col("__last")).otherwise((1 << 63) - 1).alias("__upto")), key).drop("__n", *key)
    at = part.withColumns({"s": F.col("lat") - reach, "n": F.col("lat") + reach, "w": F.col("lon") - reach, "e": F.col("lon") + reach})
    boxes = S.keyed_boxes(at, tree).withColumns({"__fy": tree.fine(F.col("lat")), "__fx": tree.fine(F.col("lon"))})
    own = (tree.at("__fy", F.col("__lv")) == F.col("__y")) & (tree.at("__fx", F.col("__lv")) == F.col("__x"))
    return boxes.select("id", "name", "lat", "lon", "__upto", own.alias("__home"), "__lv", "__y", "__x")


def greedy_apart(places: DataFrame, rules: tuple[Rule, ...], block: int = BLOCK) -> DataFrame:
    """The ids of the places (id, name, lat, lon) that go when each, in order of id, goes if one that stays before it is too near.

    Ids are whole numbers and differ. Places without coordinates stay; those without a name
    only meet rules that ask for none.
    """
    reach = max(r.metres for r in rules) / geo.M_LON * 1.000001  # the longer of a metre's degrees
    open_ = written(places.select(F.col("id").cast("long").alias("id"), "name", "lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL"), "open")
    gone: list[DataFrame] = []
    while not open_.isEmpty():
        settled = _blocks(open_, reach, block).groupBy("__lv", "__y", "__x").applyInPandas(_settle_block(rules), "id long, stays boolean")
        settled = written(settled, "settled")
        gone.append(settled.filter("NOT stays").select("id"))
        rest = written(open_.join(settled.select("id"), "id", "left_anti"), "rest")
        if rest.isEmpty():
            break
        new = open_.join(settled.filter("stays").select("id"), "id", "left_semi")
        lost = written(too_near(rest, new, rules).distinct(), "lost")
        gone.append(lost)
        open_ = written(rest.join(lost, "id", "left_anti"), "open")
    return reduce(DataFrame.unionByName, gone) if gone else open_.select("id")
