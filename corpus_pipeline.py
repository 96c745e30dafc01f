"""Corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Stages tell rows apart by the file they are in and their place there, so their decisions
concern single rows whatever the ids are:

* Rows that repeat an id with other texts are judged each by its own text.
* Of whole rows that repeat, exact dedup keeps one. Rows without an id are kept, dropped,
  mixed and packed like others.
* Null and empty texts fail the base rule of the first stage; a later stage given one keeps
  it (as one of its group of empty texts, and selected while its leaf has tokens to give).
* An empty table gives an empty result. Other columns are handed through, but none may be
  named ``__row`` or ``_metadata``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityjobs.llm import exact_dedup, jaccard, mixing, packing, quality
from cityjobs.llm.common import ROW, materialize, with_rows, without_rows
from cityjobs.llm.queries import public_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the rules reject go."""
    docs = with_rows(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = quality.judge(docs, labels, keep=(ROW,)).filter("NOT kept")
    return without_rows(docs, materialize(rejected.select(ROW), "rejected"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact deduplication: of equal texts one row of the largest doc_id stays."""
    docs = with_rows(docs)
    copies = exact_dedup.exact_dedup(docs, row_col=ROW).filter("NOT kept")
    return without_rows(docs, materialize(copies.select(ROW), "copies"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of documents linked at 0.75 or more one row of the smallest doc_id stays; no id counts as larger."""
    docs = with_rows(docs)
    out = jaccard.jaccard_components(docs, keep=(ROW,)).filter("component IS NOT NULL")
    out = materialize(out.select("component", F.struct(F.col("doc_id").isNull(), "doc_id", ROW).alias("place"), ROW), "components")
    firsts = out.groupBy("component").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    near = out.join(materialize(firsts, "firsts").hint("merge"), "component").filter("place <> least")
    return without_rows(docs, materialize(near.select(ROW), "near-copies"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: nine tenths of the tokens, shared out by the target weights; no document twice."""
    docs = with_rows(docs)
    chosen = materialize(mixing.mix(docs, budget=0.9, max_epochs=1, keep=(ROW,)).select(ROW), "chosen")
    return docs.join(chosen.hint("merge"), ROW, "left_semi").drop(ROW)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents in windows of 2048 tokens."""
    return packing.pack_documents(docs, public_file("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("packing", pack_stage),
]

#: Packing by a tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
