"""Scans in an order, with a state that rows of a key hand on to each other, over ranges of bounded size.

Rows are range-partitioned by key and order, so that a key may hold any share of them: its
rows then lie in several ranges, one after another. Every range is first scanned as if its
first key began there. Where that key began in the range before, the state in which that
one ended is handed in, and the range is scanned again; so on while states change. A state
that soon forgets where it came from settles after a round or two, however many ranges a
key spans; in any case the result is that of one scan from the first row to the last.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cityjobs.sources.shared import written

#: Rows of a range, about.
RANGE_ROWS = 50_000

#: Rows in order, the places where keys begin, and the state of the first key (None: it begins here) -> rows that are
#: returned, and the last key's state at the end (None: as if it began anew).
Scan = Callable[[pd.DataFrame, list[int], tuple | None], tuple[pd.DataFrame, tuple | None]]


def carried_scan(rows: DataFrame, key: str, order: list[str], scan: Scan, schema: str | StructType, state: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows that ``scan`` returns, of ``schema``; ``state`` is the type of what is handed on, as a list of columns, the first never null.

    Rows without a key are one key. Rows that are equal in key and order may come in either order.
    An empty table gives an empty result. A range is held by one task at a time, whatever its key's share.
    """
    n_ranges = max(1, -(-rows.count() // range_rows))
    place = [F.col(key).asc_nulls_first(), *order]
    names = [c.split()[0] for c in state.split(",")]
    ranged = written(rows.repartitionByRange(n_ranges, *place).withColumn("__part", F.spark_partition_id()), "ranges")

    def scanned(pdf: pd.DataFrame, carried: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, tuple]:
        pdf = pdf.sort_values([key, *order], na_position="first", ignore_index=True)
        k = pdf[key]
        new = (k != k.shift()) & ~(k.isna() & k.shift().isna())
        starts = [0, *(i for i in new.to_numpy().nonzero()[0].tolist() if i)]
        given = tuple(carried[names].iloc[0]) if len(carried) and not pd.isna(carried[names[0]].iloc[0]) else None
        out, end = scan(pdf.drop(columns="__part"), starts, given)
        return pdf, out, end

    def result(pdf: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        return scanned(pdf, carried)[1] if len(pdf) else pd.DataFrame()

    def ending(pdf: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame()
        pdf, _, end = scanned(pdf, carried)
        return pd.DataFrame([[pdf["__part"].iloc[0], *(end or [None] * len(names))]], columns=["__part", *names])

    def with_states(states: DataFrame, f, into: str | StructType, of: DataFrame = ranged) -> DataFrame:
        return of.groupBy("__part").cogroup(states.groupBy("__part")).applyInPandas(f, into)

    none = ranged.sparkSession.createDataFrame([], f"__part int, {state}")
    if n_ranges == 1:
        return with_states(none, result, schema)
    bounds = written(ranged.groupBy("__part").agg(F.min(F.struct(key)).alias("first"), F.max(F.struct(key)).alias("last")), "bounds")
    before = Window.orderBy("__part")  # a row for each range
    joined = bounds.select("__part", F.lag("__part").over(before).alias("__from"), F.coalesce(F.lag("last").over(before) == F.col("first"), F.lit(False)).alias("goes_on"))
    joined = written(joined.filter("goes_on").select("__part", "__from"), "continued")
    ends = written(with_states(none, ending, f"__part int, {state}", ranged.join(joined.select(F.col("__from").alias("__part")), "__part", "left_semi")), "ends")
    given = none
    while True:
        now = joined.join(ends.withColumnRenamed("__part", "__from"), "__from").select("__part", *names)
        now = written(now, "given")
        was = given.withColumnsRenamed({c: f"__{c}" for c in names})
        same = F.struct(*names).eqNullSafe(F.struct(*[F.col(f"__{c}").alias(c) for c in names]))
        changed = written(now.join(was, "__part", "left").filter(~same).select("__part", *names), "changed")
        if changed.isEmpty():
            return with_states(now, result, schema)
        given = now
        passing = changed.join(joined.select(F.col("__from").alias("__part")), "__part", "left_semi")
        again = with_states(passing, ending, f"__part int, {state}", ranged.join(passing.select("__part"), "__part", "left_semi"))
        ends = written(ends.join(passing.select("__part"), "__part", "left_anti").unionByName(again), "ends")
