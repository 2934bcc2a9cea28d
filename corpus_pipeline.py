"""A corpus pipeline of five operators, each stage working on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.  Rows with a null doc_id are kept by the filtering stages.
"""

from __future__ import annotations

import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from placetrace.llm import decontaminate, near_text, packing, quality, suffix_dedup  # noqa: E402
from placetrace.llm.tables import stored, table  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR = replace(near_text.Settings(), words=5, least=80)


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows given by id and hash of the text: another text of the same id stays.

    Rows without an id are never among them and need no join, so many of them make no hot key.
    """
    docs = docs.select(*COLUMNS)
    gone = rows.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    named = docs.where("doc_id is not null").join(gone.hint("merge"), same, "left_anti")
    return named.unionByName(docs.where("doc_id is null"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is trained on labelled rows of ``docs``."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model, threshold=0.7)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return _without(docs, near_text.surplus(docs, NEAR))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that stand earlier in the corpus."""
    found = suffix_dedup.suffix_dedup(docs.select(*COLUMNS), whole_characters=True)
    text = F.decode("kept", "UTF-8")
    return found.select(
        "doc_id",
        text.alias("text"),
        F.col("rest.lang").alias("lang"),
        F.col("rest.source").alias("source"),
        F.length(text).cast("long").alias("n_chars"),
    )


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in bins of 2048, 4096 or 8192 tokens."""
    return packing.pack(packing.token_lengths(docs))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]

# Classifier, similarity join, suffix merging and alignment are beyond SQL; tests/llm compares each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
