"""Two-pass external shuffle into shards (DataFrame operations only).

Pass one scatters the records over memory-sized buckets by a seeded hash. Pass two
Fisher-Yates shuffles every bucket (``shuffle`` draws a seeded random permutation in
that way) and writes it. The buckets one after another are a uniform random order of
all records; shards are equal slices of that order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import before_each, materialize, shared_dir, text_or_empty

#: Tasks of the second pass; a task takes several buckets one after another where there are more of these.
MAX_TASKS = 1 << 16


def external_shuffle(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_shards: int = 16,
    seed: int = 17,
    bucket_bytes: int = 16 << 20,
) -> DataFrame:
    """All rows and columns of ``df`` plus ``shard`` (0 .. n_shards - 1) and ``slot`` (gapless from 0).

    The law is ``rows``: the shards' row counts differ by one at most. ``bucket_bytes`` is
    the text a task holds at once; on a large cluster set it to a tenth of a task's memory.

    * The order depends on the ids, the seed and the sizes only, not on how the input is split.
    * A row without an id is scattered by its text. Rows that share an id, or a text without an
      id, meet in one bucket; where they have more than a quarter of ``bucket_bytes``, they are
      scattered each by itself, by where they lie in the input. So they may be any share of the rows.
    * Null texts have no bytes. An empty table gives an empty result.
    * Columns named like the added ones are replaced. A column may be a map, but hold none.
    """
    cols = [c for c in df.columns if c not in ("shard", "slot")]
    df = df.select(*cols)
    maps = {f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)}  # maps have no order; their entries have
    size = F.octet_length(text_or_empty(text_col)) + 1
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    total, n_buckets = sizes["n"], max(1, math.ceil(sizes["b"] / bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))
    # sums are combined in the tasks; a heavy key has a quarter of a bucket, so there are four for each bucket at most
    heavy = df.groupBy(key.alias("__heavy")).agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).filter((F.col("b") > bucket_bytes / 4) & (F.col("n") > 1))
    heavy = materialize(heavy.select("__heavy"), "heavy-keys")
    keyed = df.withColumn("__key", key)
    if not heavy.isEmpty():
        keyed = materialize(keyed.withColumn("__number", F.monotonically_increasing_id()), "numbered")  # written, so that numbers stay
        keyed = keyed.join(heavy, F.col("__key") == F.col("__heavy"), "left")
        keyed = keyed.withColumn("__key", F.when(F.col("__heavy").isNotNull(), F.xxhash64("__key", "__number")).otherwise(F.col("__key")))
    bucket = F.pmod("__key", F.lit(n_buckets)).alias("__bucket")
    counts = keyed.groupBy(bucket).count()
    starts = materialize(before_each(counts, "__bucket", F.col("count"), "__first"), "bucket-starts")
    sortable = [F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(f"`{c}`") for c in cols]
    scattered = keyed.select(bucket, F.struct(F.col("__key"), *sortable).alias("__row")).repartition(min(n_buckets, MAX_TASKS), "__bucket")
    filled = scattered.groupBy("__bucket").agg(F.array_sort(F.collect_list("__row")).alias("__rows")).sortWithinPartitions("__bucket")
    mixed = filled.withColumn("__rows", F.shuffle("__rows", seed)).join(starts, "__bucket")
    placed = mixed.select("__first", F.posexplode("__rows").alias("__pos", "__row")).withColumn("__at", F.col("__first") + F.col("__pos"))
    shard = F.expr(f"__at * {n_shards} div {max(1, total)}")
    placed = placed.withColumn("shard", shard.cast("int"))
    slot = F.col("__at") - F.expr(f"(CAST(shard AS BIGINT) * {total} + {n_shards - 1}) div {n_shards}")
    back = [(F.map_from_entries(F.col("__row")[c]) if c in maps else F.col("__row")[c]).alias(c) for c in cols]
    return placed.select(*back, "shard", slot.cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Shuffle ``df``, write it (each file is a slice of one task's buckets, in slot order) and return the written table."""
    path = path or shared_dir(df.sparkSession, "shards")
    out = external_shuffle(df, **options)
    out.write.parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)
