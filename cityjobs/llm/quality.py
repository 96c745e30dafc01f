"""Quality rules whose thresholds are certified on labelled documents (DataFrame operations only).

Every rule is a feature of a document that is large in bad text, with a grid of cut-offs.
The cut-offs of all rules form one ladder of joint sets, each a little stricter than the
one before; its order comes from the documents labelled bad alone. For each stratum
(language) the steps are tested from the loosest on: a step is certified when the exact
binomial upper bound of the share of good documents that any of its rules rejects is at
most ``alpha``, and the last step before the first failure holds (fixed-sequence testing,
so the level ``delta`` is shared among strata only). Strata with too few good labels for
any certificate take the step of the pool of all strata. So with probability 1 - delta no
stratum with a test of its own, nor all strata together, loses more than ``alpha`` of its
good documents to these rules; for a pooled stratum alone there is no such bound.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, words

SYMBOLS = "[#*$%&|<>]"
ALPHA, DELTA = 0.01, 0.05
#: Rule -> cut-offs tried; a document is rejected where its feature is above the cut-off.
GRID = {
    "symbol_rate": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0],
    "dup_line_rate": [0.05, 0.1, 0.2, 0.3, 0.5],
    "repeat_word_rate": [0.05, 0.1, 0.2, 0.3, 0.4],
    "upper_rate": [0.1, 0.2, 0.3, 0.5, 0.8],
    "word_length": [7.0, 8.0, 9.0, 10.0, 12.0, 16.0, 32.0],
}


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts that the rules are made of; all within a row, so nothing is shuffled.

    Repeated windows are found by sorting the 64-bit hashes of a text's windows: linear
    memory and n log n time in its length. Null texts have no words.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), *keep, text_or_empty(text_col).alias("__t"))
    t = t.withColumn("__w", words(F.col("__t"))).withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    t = t.select(
        "doc_id",
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("__t", F.lit("[A-Z!]")).cast("long").alias("n_upper"),
        "__w",
    )
    at = F.when(F.size("__w") >= 3, F.sequence(F.lit(0), F.size("__w") - 3))
    t = t.withColumn("__h", F.transform(at, lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))).drop("__w")
    t = t.withColumn("__s", F.sort_array("__h"))
    t = t.withColumn("__dup", F.array_distinct(F.filter("__s", lambda h, i: (i > 0) & (h == F.get("__s", i - 1))))).drop("__s")
    # where windows repeat, their places: by lookup while few hashes repeat, else by one sort of (hash, place)
    few = F.filter(F.transform("__h", lambda h, i: F.when(F.array_contains("__dup", h), i)), lambda i: i.isNotNull())
    pairs = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    t = t.withColumn("__pairs", F.when(F.size("__dup") > 64, pairs))
    many = F.sort_array(
        F.transform(
            F.filter(
                "__pairs",
                lambda p, i: ((i > 0) & (F.get("__pairs", i - 1)["h"] == p["h"])) | F.coalesce(F.get("__pairs", i + 1)["h"] == p["h"], F.lit(False)),
            ),
            lambda p: p["i"],
        )
    )
    places = F.when(F.coalesce(F.size("__dup"), F.lit(0)) <= 0, F.array().cast("array<int>")).when(F.size("__dup") <= 64, few).otherwise(many)
    t = t.withColumn("__at", places).drop("__h", "__dup", "__pairs")
    covered = F.aggregate(
        F.transform("__at", lambda a, i: F.least(F.lit(3), F.coalesce(F.get("__at", i + 1) - a, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x
    )
    return t.withColumn("n_repeat_words", covered).drop("__at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_rate": F.col("n_symbols") / n,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_word_rate": F.col("n_repeat_words") / n,
        "upper_rate": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "word_length": F.col("word_chars") / n,
    }


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact: the term at k in logarithms, times the sum of the terms relative to it.

    Only evaluated up to k < n * p, above which no certificate is possible.
    """
    odds = math.log(p) - math.log1p(-p)
    ones = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    top = F.aggregate(ones, n * F.lit(math.log1p(-p)), lambda s, i: s + F.log((n - i + 1) / i) + F.lit(odds))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * i / (n - i + 1) * F.lit(math.exp(-odds))
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    return F.exp(top) * F.aggregate(F.reverse(ones), start, step, lambda s: s["total"])


def ladder_of(levels: list[tuple[tuple[int, ...], int]], grid: dict[str, list[float]] = GRID) -> list[tuple[str, float]]:
    """All (rule, cut-off) of the grid in the order in which they are added to the joint set.

    ``levels`` holds for bad documents the number of cut-offs that each rule's value is above,
    and how many documents have these. The cut-off that catches most bad documents not caught
    yet comes next, after the looser ones of its rule; when none catches more, the rules are
    tightened in turn. No good document has a say, so testing along the ladder stays exact.
    """
    rules, out = list(grid), []
    at = {r: len(grid[r]) for r in rules}  # cut-offs from here on are in the set

    def add(rule: str, upto: int) -> None:
        while at[rule] > upto:
            at[rule] -= 1
            out.append((rule, float(grid[rule][at[rule]])))

    left = list(levels)
    while left:
        gain: Counter = Counter()
        for level, n in left:
            for r, v in zip(rules, level, strict=True):
                for i in range(v):
                    gain[r, i] += n
        best = max(gain, key=lambda x: (gain[x], x[1] - len(grid[x[0]]), -rules.index(x[0])), default=None)
        if best is None:
            break
        add(*best)
        left = [(level, n) for level, n in left if level[rules.index(best[0])] <= best[1]]
    while any(at.values()):
        rule = max(rules, key=lambda r: (at[r], -rules.index(r)))
        add(rule, at[rule] - 1)
    return out


def certified_cutoffs(
    features: DataFrame, labels: DataFrame, stratum: str = "stratum", alpha: float = ALPHA, delta: float = DELTA, grid: dict[str, list[float]] = GRID
) -> DataFrame:
    """Rows (stratum, cut_<rule>...) with the certified joint cut-offs of a stratum, null for a rule that takes no part.

    The row of stratum null is that of the pool; it holds for all strata without a row. A
    stratum that was tested and has no certificate has a row of nulls. ``labels`` holds
    doc_id and quality; a document with several labels is good when none of them is 0, and
    labels or ids that are null are ignored.
    """
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q IN (0, 1)").withColumnRenamed("doc_id", "__id")
    rated = features.join(marks, F.col("doc_id") == F.col("__id")).filter((F.col("q") == 1) | ~base_failed())
    level = [sum(((v > c).cast("int") for c in grid[r]), F.lit(0)).alias(r) for r, v in rule_values().items()]
    counts = rated.select(F.col(stratum).alias("stratum"), "q", *level).groupBy("stratum", "q", *grid).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "holdout-counts")
    # one row for each mix of levels, however many documents there are
    bad = counts.filter("q = 0").groupBy(*grid).agg(F.sum("n").alias("n")).collect()
    ladder = ladder_of([(tuple(r[x] for x in grid), r["n"]) for r in bad], grid)
    # the first step whose set rejects a document: the cut-offs of a rule join from the loosest down
    joins = [F.when(F.col(r) > grid[r].index(c), F.lit(i)) for i, (r, c) in enumerate(ladder)]
    good = counts.filter("q = 1").select("stratum", "n", F.coalesce(*joins, F.lit(len(ladder))).alias("step"))
    ks = [F.sum(F.when(F.col("step") <= i, F.col("n")).otherwise(0)).alias(f"k{i}") for i in range(len(ladder))]
    per = materialize(good.groupBy("stratum").agg(F.sum("n").alias("n"), *ks), "step-counts")
    pool = per.agg(F.sum("n").alias("n"), *[F.sum(f"k{i}").alias(f"k{i}") for i in range(len(ladder))]).withColumn("stratum", F.lit(None).cast("string"))

    def least(tests: int) -> int:
        """Good labels from which a set without a false rejection is certified."""
        return math.ceil(math.log(delta / tests) / math.log1p(-alpha))

    tests = per.filter(F.col("n") >= least(2)).count() + 1
    tested = per.filter(F.col("n") >= least(tests)).unionByName(pool.filter(F.col("n") > 0))
    tested = tested.select("stratum", "n", F.array(*[F.col(f"k{i}") for i in range(len(ladder))]).alias("ks"))
    one = tested.select("stratum", "n", F.posexplode("ks").alias("step", "k"))
    held = F.col("k") < F.col("n") * F.lit(alpha)
    sure = F.when(held, binomial_cdf(F.col("k"), F.col("n"), alpha)).otherwise(F.lit(1.0)) <= F.lit(delta / tests)
    last = one.groupBy("stratum").agg(F.coalesce(F.min(F.when(~sure, F.col("step"))), F.lit(len(ladder))).alias("steps"))
    cuts = [F.when(F.col("steps") > i, F.lit(c)) for i, (_, c) in enumerate(ladder)]
    cols = [F.coalesce(*reversed([x for (r, _), x in zip(ladder, cuts, strict=True) if r == rule])).alias(f"cut_{rule}") for rule in grid]
    return materialize(last.select("stratum", *cols), "cutoffs")


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Counts and verdict per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, failed_rules, stratum[, keep...].

    * Null or empty texts have no words and fail the base rule. Null strata are the stratum ''.
    * A stratum without enough labelled documents takes the cut-offs of all strata together;
      without enough labels in all, or in any, documents are lost to the base rule only.
    * Repeated rows are judged each on its own; an empty table gives an empty result.
    * Any stratum may hold any share of the rows: its counts are combined before the shuffle.
    """
    named = docs.select(id_col, text_col, F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), *keep)
    features = materialize(text_features(named, id_col, text_col, ("stratum", *keep)), "features")
    cutoffs = certified_cutoffs(features, labels, alpha=alpha, delta=delta).withColumnRenamed("stratum", "__stratum")
    pool = cutoffs.filter("__stratum IS NULL").head()
    out = features.join(cutoffs, F.col("stratum") == F.col("__stratum"), "left").withColumn("base_failed", base_failed())
    own = F.col("__stratum").isNotNull()
    out = out.withColumns({c: F.when(own, F.col(c)).otherwise(F.lit(pool and pool[c]).cast("double")) for c in cutoffs.columns[1:]})
    failed = F.filter(F.array(*[F.when(v > F.col(f"cut_{r}"), F.lit(r)) for r, v in rule_values().items()]), lambda r: r.isNotNull())
    out = out.withColumn("failed_rules", failed)
    return out.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
        "failed_rules",
        "stratum",
        *keep,
    )
