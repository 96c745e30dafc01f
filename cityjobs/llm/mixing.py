"""Mixing sources to target weights by hierarchical budgeting (DataFrame operations only).

The sources form a tree domain -> language -> source. A token budget flows down it:
every node shares its budget among its children by weight, but no child gets more than
it can deliver (its tokens times the allowed epochs). What a short child leaves goes to
its siblings first; only what the whole family cannot deliver reaches the parent's
siblings. A leaf then reads its documents in a seeded order, epoch after epoch, and the
prefix of that stream that its budget covers is selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, words

#: Weights of the production mix; a node not named here has weight 1.
WEIGHTS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0, "en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
LEVELS = ("domain", "language", "source")
#: Hex digits of a document's seeded order that name its slice of the leaf.
SLICE_DIGITS = 3


def domain_of(source: Column) -> Column:
    """Five consecutive source numbers make a domain; names without a number are domain ``d``."""
    return F.concat(F.lit("d"), F.coalesce(F.expr("try_cast(regexp_extract(__source, '([0-9]+)$', 1) AS BIGINT) div 5").cast("string"), F.lit("")))


def weight_of(name: Column, weights: dict[str, float]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), name) if weights else F.lit(None), F.lit(1.0)).cast("double")


def share_out(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """Add ``alloc`` (long): ``budget`` of the parent shared by ``weight`` under the bound ``capacity``.

    Closed form of filling siblings to one level: in order of capacity a unit of weight,
    a node is full while its own capacity is under the level that the rest would get.
    Whole tokens come from differences of the running total, so they sum up exactly.
    """
    order = [F.col("capacity") / F.col("weight"), F.col("name")]
    upto = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    family = Window.partitionBy(*parent)
    n = nodes.withColumns(
        {
            "__budget": F.least(budget, F.sum("capacity").over(family)),
            "__c": F.coalesce(F.sum("capacity").over(upto), F.lit(0)),
            "__w": F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
            "__all": F.sum("weight").over(family),
        }
    )
    level = (F.col("__budget") - F.col("__c")) / (F.col("__all") - F.col("__w"))
    n = n.withColumn("__full", F.col("capacity") / F.col("weight") <= level)
    open_first = F.min(F.when(~F.col("__full"), F.struct(F.col("__c").alias("c"), F.col("__w").alias("w")))).over(family)
    n = n.withColumn("__open", open_first)
    # running weight among the nodes that are not full, before and with this one
    level = (F.col("__budget") - F.col("__open.c")) / (F.col("__all") - F.col("__open.w"))
    upper = F.floor((F.col("__w") + F.col("weight") - F.col("__open.w")) * level + 1e-6)
    lower = F.floor((F.col("__w") - F.col("__open.w")) * level + 1e-6)
    alloc = F.when(F.col("__full"), F.col("capacity")).otherwise(F.least(F.col("capacity"), upper - lower))
    return n.withColumn("alloc", alloc.cast("long")).drop("__budget", "__c", "__w", "__all", "__full", "__open")


def leaf_budgets(leaves: DataFrame, total: Column, max_epochs: int, weights: dict[str, float]) -> DataFrame:
    """Rows (domain, language, source, tokens) with ``alloc``, top-down through the tree."""
    done: DataFrame | None = None
    for depth in range(1, len(LEVELS) + 1):
        path, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("capacity")).withColumn("name", F.col(path[-1]))
        nodes = nodes.withColumn("weight", weight_of(F.col("name"), weights))
        if done is None:
            nodes = share_out(nodes.withColumn("__root", F.lit(0)), ["__root"], total)
        else:
            nodes = share_out(nodes.join(done, parent), parent, F.col("__given"))
        done = nodes.select(*path, F.col("alloc").alias("__given"))
    return done.withColumnRenamed("__given", "alloc")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    budget: float = 0.9,
    max_epochs: int = 2,
    weights: dict[str, float] = WEIGHTS,
    seed: int = 11,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Documents selected for a token budget of ``budget`` times all tokens.

    Returns id, domain, language, source, epoch (from 0), start (tokens of the leaf's
    stream before the document), n_tokens, take_tokens (less than n_tokens only for the
    document that the prefix ends in), leaf_alloc[, keep...]. Tokens are words.

    * Null texts count as empty; documents without tokens are selected while the stream
      has tokens left to give. Null languages and sources are the nodes ''.
    * Rows whose id is null or repeated are put in order each by itself, by a number that
      follows from where they lie in the input; so they may be any share of the rows.
    * An empty table gives an empty result; other columns are ignored.
    * A leaf may hold any share of the rows: its stream is summed in 4096 slices of the
      seeded order, and only documents within a slice meet in one task.
    """
    base = docs.select(
        F.col(id_col).alias("__id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("__source"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("language"),
        F.size(words(text_or_empty(text_col))).cast("long").alias("n_tokens"),
        *keep,
    )
    base = base.select("__id", domain_of(F.col("__source")).alias("domain"), "language", F.col("__source").alias("source"), "n_tokens", *keep)
    base = materialize(base.withColumn("__number", F.monotonically_increasing_id()), "mix-sizes")
    unique = F.col("__id").cast("string")
    again = materialize(base.filter("__id IS NOT NULL").groupBy("__id").count().filter("count > 1").select(F.col("__id").alias("__again")), "repeated-ids")
    if again.isEmpty():
        base = base.withColumn("__name", F.coalesce(unique, F.concat(F.lit("#"), "__number")))
    else:
        base = base.join(again, F.col("__id") == F.col("__again"), "left")
        base = base.withColumn("__name", F.when(F.col("__again").isNull() & F.col("__id").isNotNull(), unique).otherwise(F.concat_ws("#", unique, F.col("__number"))))
    leaves = materialize(base.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(budget))
    total = leaves.select(total.alias("t")).limit(1).first()  # one number
    budgets = leaf_budgets(leaves, F.lit(total["t"] if total else 0), max_epochs, weights)
    budgets = leaves.join(budgets, list(LEVELS)).withColumn("__epochs", F.greatest(F.lit(1), F.ceil(F.col("alloc") / F.greatest(F.col("tokens"), F.lit(1)))).cast("int"))
    budgets = materialize(budgets, "leaf-budgets")

    stream = (
        base.join(budgets, list(LEVELS))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__epochs") - 1)))
        .withColumn("__order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), "__name").cast("binary")))
        .withColumn("__slice", F.substring("__order", 1, SLICE_DIGITS))
    )
    leaf = [*LEVELS, "epoch"]
    sums = stream.groupBy(*leaf, "__slice").agg(F.sum("n_tokens").alias("__sum"))
    before_slice = Window.partitionBy(*LEVELS).orderBy("epoch", "__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before_slice), F.lit(0))).drop("__sum"), "slices")
    before = Window.partitionBy(*leaf, "__slice").orderBy("__order", "__number").rowsBetween(Window.unboundedPreceding, -1)
    placed = stream.join(sums, [*leaf, "__slice"]).withColumn("start", F.col("__before") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return placed.filter("start < alloc").select(
        F.col("__id").alias(id_col), *leaf, "start", "n_tokens", F.least(F.col("n_tokens"), F.col("alloc") - F.col("start")).alias("take_tokens"), F.col("alloc").alias("leaf_alloc"), *keep
    )
