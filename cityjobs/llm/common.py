"""Shared pieces of the training-data operators: scratch tables, token and text columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityjobs.sources.shared import shared_dir, written  # noqa: F401
from cityjobs.sources.shipping import ship_package

#: ASCII white space, the only separators of words.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that a task writes at least, where their number is known to be small.
ROWS_PER_TASK = 250_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a plain Parquet scan.

    This cuts lineage (a lost executor re-reads a file, not the whole plan) and
    gives the planner true sizes, so that it broadcasts the table only when the
    measured size is under ``spark.sql.autoBroadcastJoinThreshold``. Where ``rows``, a bound
    of its rows, is given, no more tasks write it than these are worth.
    """
    return written(df if rows is None else df.coalesce(max(1, -(-rows // ROWS_PER_TASK))), name)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors and keep Arrow batches of whole texts small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # the default; whole texts make such batches too large
        spark.conf.set(key, "1000")
    ship_package(spark)


ROW = "__row"


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, the file of each row and its place there: rows are told apart whatever their ids are.

    A frame that is no plain scan of Parquet files is written first. A column named
    ``_metadata`` or ``__row`` is not allowed.
    """
    try:
        return docs.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(ROW))
    except AnalysisException:
        return with_rows(materialize(docs, "rows"))


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``with_rows(docs)`` whose ``__row`` is not in ``dropped``, without that column.

    A sort-merge join whatever the sizes: both sides grow with the data, and AQE splits skew.
    """
    return docs.join(dropped.select(ROW).hint("merge"), ROW, "left_anti").drop(ROW)


def before_each(df: DataFrame, key: str, value: Column, out: str, span: int = 4096) -> DataFrame:
    """Rows (key, out): the sum of ``value`` over all smaller keys, ``df`` having a row for each whole number ``key``.

    Two levels, so that no window holds more than ``span`` rows or one for each span.
    """
    rows = df.select(F.col(key).cast("long").alias(key), value.cast("long").alias("__v"), F.floor(F.col(key) / span).alias("__span"))
    upto = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("__span").agg(F.sum("__v").alias("__s")).select("__span", F.coalesce(F.sum("__s").over(upto), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__span").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(spans, "__span").select(key, (F.col("__before") + F.coalesce(F.sum("__v").over(within), F.lit(0))).alias(out))


def text_or_empty(col: str | Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; an empty list if none."""
    return F.filter(F.split(text, WORD_SPLIT), lambda w: w != F.lit(""))
