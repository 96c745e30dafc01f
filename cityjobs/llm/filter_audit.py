"""Audit of how filters interact, from joint-failure counts of all their intersections.

Every document gets a flag for each filter that it fails. For each of the 32 sets of
filters, the products of the flags are summed: J(S) documents fail all filters of S. All
else follows from these 32 numbers of a part by inclusion and exclusion (Moebius inversion
over subsets): what survives any set of filters, what one filter alone would have removed,
what earlier filters had removed already, and the Harsanyi dividends (-1)^(|S|+1) J(S),
whose equal shares sum to each filter's Shapley value. No order of filters is ever run.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, words

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SYMBOLS = "[#$%&*|]"


def own_failures(text: Column) -> dict[str, Column]:
    """Filters A to D, which a text fails by itself, as 0 or 1: few words, few distinct words, capitals, symbols."""
    w = words(text)
    failed = {
        "A": F.size(w) < 50,
        "B": 100 * F.size(F.array_distinct(w)).cast("long") < 65 * F.size(w).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.char_length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }
    return {k: c.cast("long") for k, c in failed.items()}


def failure_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Rows (doc_id, part, A, B, C, D, E) with flags 0 or 1, one per document.

    Texts are read once; from then on only their SHA-256 moves. The least id of every text
    that several rows have is combined in the tasks before the shuffle, and joined back to
    the flags by a sort-merge join, which AQE splits where copies are many.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).alias("__t"))
    flags = base.select("doc_id", "part", F.unhex(F.sha2(F.encode("__t", "UTF-8"), 256)).alias("__sha"), *[c.alias(k) for k, c in own_failures(F.col("__t")).items()])
    flags = materialize(flags, "flags")
    copies = flags.groupBy("__sha").agg(F.min("doc_id").alias("__least"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    copies = materialize(copies, "copies")
    later = F.coalesce(F.col("doc_id") > F.col("__least"), F.lit(False)).cast("long")
    return flags.join(copies.hint("merge"), "__sha", "left").select("doc_id", "part", *"ABCD", later.alias("E"))


def joint_failures(flagged: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """A row per part: for each measure the array J, J[S] being its sum over documents that fail all filters of the set S.

    Bit i of S stands for filter i. Documents are first counted by equal flags and measures,
    in the tasks, so that a part may hold any share of them.
    """
    cells = flagged.select("part", *FILTERS, *[c.cast("long").alias(k) for k, c in measures.items()]).groupBy("part", *FILTERS, *measures).agg(F.count(F.lit(1)).alias("__n"))

    def product(s: int, measure: str) -> Column:
        out = F.col("__n") * F.col(measure)
        for i, f in enumerate(FILTERS):
            out = out * F.col(f) if s >> i & 1 else out
        return out

    sums = cells.groupBy("part").agg(*[F.sum(product(s, m)).alias(f"__{m}_{s}") for m in measures for s in range(SETS)])
    return sums.select("part", *[F.array(*[f"__{m}_{s}" for s in range(SETS)]).alias(m) for m in measures])


def _over_sets(term) -> Column:
    """Sum of ``term(set, its sign)`` over all sets of filters, the sign being (-1)^size."""
    sign = lambda s: 1 - 2 * (F.bit_count(s) % 2)
    return F.aggregate(F.sequence(F.lit(0), F.lit(SETS - 1)), F.lit(0).cast("long"), lambda acc, s: acc + term(s, sign(s)))


def survivors(joint: Column) -> Column:
    """Array: how many documents fail none of the filters of each set."""
    inside = lambda s, u: s.bitwiseAND(u) == s
    return F.transform(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda u: _over_sets(lambda s, sign: F.when(inside(s, u), sign * F.get(joint, s)).otherwise(0)))


def only_here(joint: Column, bit: Column) -> Column:
    """How many documents fail the filter of ``bit`` and no other: the Moebius inverse at that set."""
    return _over_sets(lambda s, sign: F.when(s.bitwiseAND(bit) != 0, -sign * F.get(joint, s)).otherwise(0))


def shapley(joint: Column, bit: Column) -> Column:
    """The Shapley value of a filter times the number of orders, a whole number: shares of the dividends of its sets."""
    share = lambda s: (F.lit(factorial(len(FILTERS))) / F.greatest(F.bit_count(s), F.lit(1))).cast("long")
    return _over_sets(lambda s, sign: F.when(s.bitwiseAND(bit) != 0, -sign * share(s) * F.get(joint, s)).otherwise(0))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Rows (part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, failing).

    One row for every part, each of the 120 orders and its five steps. ``failing`` counts
    what fails the step's filter at all, removed earlier or not.

    * Null texts count as empty, null parts as the part ''.
    * A row without an id fails E never, and never makes others fail it. Rows that repeat an
      id and text are not copies of each other, only of smaller ids.
    * A document with several labels is good or toxic if any label says so; labels without
      an id or of no document are ignored.
    * An empty table gives an empty result; without labels, nothing is good or toxic.
      Other columns are ignored.
    """
    of = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__doc"))
    marks = of.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    marks = materialize(marks, "marks")
    flagged = failure_flags(docs, id_col, text_col, part_col).join(marks.hint("merge"), F.col("doc_id") == F.col("__doc"), "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    joint = joint_failures(flagged, {"n": F.lit(1), "good": none(F.col("good")), "toxic": none(F.col("toxic"))})
    # written: few rows, and what follows refers to each array many times
    joint = materialize(joint, "joint")
    left = joint.select("part", "n", *[survivors(F.col(m)).alias(f"left_{m}") for m in ("n", "good", "toxic")])
    left = left.withColumn("by_filter", F.array(*[F.struct(only_here(F.col("n"), F.lit(1 << i)).alias("only"), shapley(F.col("n"), F.lit(1 << i)).alias("shapley")) for i in range(len(FILTERS))]))
    left = materialize(left, "survivors")

    orders = left.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(ORDERS)), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))

    def filters_in(prefix: Column) -> Column:
        out = F.lit(0)
        for i, f in enumerate(FILTERS):
            out = out + F.when(F.instr(prefix, f) > 0, 1 << i).otherwise(0)
        return out

    steps = orders.withColumns(
        {
            "filter": letter,
            "at": F.instr(F.lit(FILTERS), letter) - 1,
            "before": filters_in(F.substring("filter_order", F.lit(1), F.col("step") - 1)),
            "after": filters_in(F.substring("filter_order", F.lit(1), F.col("step"))),
        }
    )
    lost = lambda m: F.get(f"left_{m}", F.col("before")) - F.get(f"left_{m}", F.col("after"))
    failing = F.get("n", F.col("after") - F.col("before"))  # the set of the step's filter alone
    own = F.get("by_filter", F.col("at"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        "filter",
        F.get("left_n", F.col("after")).alias("kept"),
        lost("n").alias("removed"),
        (failing - lost("n")).alias("redundant"),
        own["only"].alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        own["shapley"].alias("shapley"),
        failing.alias("failing"),
    )
