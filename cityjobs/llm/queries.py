"""The registered query of each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, filter_audit, id_files, jaccard, lattice, mixing, packing, quality, sharding, style_tree, vector_codes, warc
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are written in the shared folder and read back; all columns come from what was read."""
    archive = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records go through the shuffle and the written shards; the digests are taken from those."""
    shards = sharding.write_shards(table(spark, sf_dir, "documents"))
    return shards.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def public_file(name: str) -> str:
    """A public tokenizer's file on this machine; every executor has the same."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_scores(table(spark, sf_dir, "documents"), public_file("piece_bpe_32k.model"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.jaccard_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id files are written in the shared folder and read back; all columns come from what was read."""
    folder = id_files.write_ids(table(spark, sf_dir, "documents"), public_file("word_bpe_49k.json"))
    return id_files.read_ids(spark, folder)


def op9_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.main_texts(table(spark, sf_dir, "pages"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_warc_writer": op2_warc_writer,
        "op3_external_shuffle": op3_external_shuffle,
        "op4_lattice_score": op4_lattice_score,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_id_files": op7_id_files,
        "op8_source_mix": op8_source_mix,
        "op9_style_tree": op9_style_tree,
        "op10_quality_rules": op10_quality_rules,
        "op11_filter_audit": op11_filter_audit,
        "op12_benchmark_windows": op12_benchmark_windows,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
