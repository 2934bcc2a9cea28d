"""Shared DataFrame helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrace.session import checkpoint

HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only doc_id (long) and text (string); other columns cannot clash later."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(column="doc_id"):
    """True where crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int) -> DataFrame:
    """(doc_id, text, label) of at most ``size`` labelled rows outside the held-out part.

    The sample is the rows of smallest hash, so it is the same on every run, and
    bounded, so that it is broadcast and the texts are not shuffled.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(size)
    )
    return texts(docs).join(F.broadcast(chosen), "doc_id")


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder and read back; survives lost executors."""
    return checkpoint(df)
