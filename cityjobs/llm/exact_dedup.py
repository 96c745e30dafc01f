"""Exact document deduplication over content-defined chunk recipes (DataFrame operations only).

A text is cut where its own content says so (the end of a sentence or line after a
least length, or the greatest length), each chunk gets a 64-bit identifier, and a
document becomes the ordered list of its chunks' identifiers: its recipe. Chunk texts
cross the network once, combined on the map side, to verify that every identifier
stands for one content; an identifier with several contents is split by an ordinal.
From then on only recipes move, never the long texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty


def chunk_pattern(min_chars: int, max_chars: int) -> str:
    """Regular expression whose consecutive matches cover any text."""
    return rf"(?s).{{{min_chars},{max_chars}}}?(?:[.!?;:>}}][ \n]|\n|\z)|.{{1,{max_chars}}}"


def chunks(text: Column, min_chars: int = 768, max_chars: int = 8192) -> Column:
    """The content-defined chunks of a text, in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(min_chars, max_chars)), F.lit(0))


def verified_recipes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 768,
    max_chars: int = 8192,
    identifier: Callable[[Column], Column] = F.xxhash64,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, text_sha256, n_bytes, recipe (ordered ``struct<h, ord>``)[, keep...].

    Two recipes are equal exactly when the texts are equal.
    """
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), *keep)
    cut = base.withColumn("__chunks", chunks(F.col("__text"), min_chars, max_chars)).withColumn("__text_sha", F.sha2(F.encode("__text", "UTF-8"), 256))
    raw = materialize(
        cut.select(
            "__id",
            F.col("__text_sha").alias("text_sha256"),
            F.octet_length("__text").cast("long").alias("n_bytes"),
            F.transform("__chunks", lambda c: identifier(c)).alias("__h"),
            *keep,
        ),
        "recipes",
    )
    rows = cut.select("__id", "__text_sha", F.posexplode("__chunks").alias("__pos", "__chunk")).withColumn("__h", identifier(F.col("__chunk")))
    contents = rows.select("__h", "__chunk").distinct()
    clashing = materialize(contents.groupBy("__h").count().filter("count > 1").select("__h"), "clashing")
    if clashing.isEmpty():
        return raw.select(F.col("__id").alias(id_col), "text_sha256", "n_bytes", F.transform("__h", lambda h: F.struct(h.alias("h"), F.lit(0).alias("ord"))).alias("recipe"), *keep)
    # some identifier has several contents: number them, and patch the recipes that hold one
    of_clashing = rows.join(clashing, "__h")
    numbered = materialize(
        of_clashing.select("__h", "__chunk").distinct().withColumn("__ord", F.dense_rank().over(Window.partitionBy("__h").orderBy("__chunk")) - 1), "numbered"
    )
    patches = (
        of_clashing.join(numbered.filter("__ord > 0"), ["__h", "__chunk"])
        .select("__text_sha", "__pos", "__ord", "__h")
        .groupBy("__text_sha")  # of one text, whatever ids its rows have
        .agg(F.array_sort(F.collect_set(F.struct("__pos", "__h", "__ord"))).alias("__patch"))
    )
    patched = raw.join(patches, F.col("text_sha256") == F.col("__text_sha"), "left").withColumn(
        "recipe",
        F.transform(
            "__h",
            lambda h, i: F.struct(
                h.alias("h"),
                F.coalesce(F.get(F.filter("__patch", lambda p: (p["__pos"] == i) & (p["__h"] == h)), 0)["__ord"], F.lit(0)).alias("ord"),
            ),
        ),
    )
    return patched.select(F.col("__id").alias(id_col), "text_sha256", "n_bytes", "recipe", *keep)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, **recipe_options) -> DataFrame:
    """Groups of documents with identical texts; the largest id of each group stays.

    Returns one row per input row: id, keep_id, group_size, kept, text_sha256, n_bytes[, row_col].
    With ``row_col``, a column that tells rows apart, exactly one row of each group is kept:
    of rows that repeat the largest id, or where no row has an id, the one of the largest ``row_col``.

    * Null texts count as empty; all empty texts form one group.
    * Null ids never win against other ids; a group of null ids only has a null
      keep_id and all its rows are kept.
    * Rows that repeat both id and text each count in group_size, and where theirs is
      the largest id, all of them are kept.
    * Where chunk identifiers clash (64-bit, so never in practice), texts are told apart by
      their SHA-256 while the clash is settled.
    * An empty table gives an empty result; other columns are ignored.
    * A group may hold any share of the rows: group sums are combined before the
      shuffle, and the way back is a plain join that AQE splits where it is skewed.
    """
    rows = (row_col,) if row_col else ()
    recipes = materialize(verified_recipes(docs, id_col, text_col, keep=rows, **recipe_options), "verified")
    last = [F.max(F.struct(F.col(id_col).alias("i"), F.col(row_col).alias("r")))["r"].alias("__keep_row")] if row_col else []
    groups = recipes.groupBy("recipe").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"), *last).filter("group_size > 1")
    groups = materialize(groups, "groups").withColumnRenamed("recipe", "__recipe")
    back = recipes.join(groups, F.col("recipe") == F.col("__recipe"), "left")
    kept = F.col("__keep_row").isNull() | (F.col(row_col) == F.col("__keep_row")) if row_col else None
    keep = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return back.select(
        id_col,
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (kept if row_col else F.col(id_col).eqNullSafe(keep)).alias("kept"),
        "text_sha256",
        "n_bytes",
        *rows,
    )
