"""Names: recovery of missing ones, and the split of unusable observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.functions.rules import exclusion_reason
from placetrace.functions.text import has_real_name, is_placeholder
from placetrace.operators.joins import join_needed


def recover_names(obs: DataFrame) -> DataFrame:
    """Give a nameless row the only named identity of its id in the same archive.

    The right side has one row per (archive, id); ids are counted over distinct
    names, so a busy id costs no more than a quiet one after the first combine.
    """
    named = obs.filter(F.col("station_id").isNotNull() & has_real_name(F.col("name_key")))
    spellings = named.groupBy("archive", "station_id", "name_key").agg(
        F.min("station_name").alias("station_name")
    )
    single = (
        spellings.groupBy("archive", "station_id")
        .agg(F.count(F.lit(1)).alias("names"), F.min(F.struct("name_key", "station_name")).alias("only"))
        .filter("names = 1")
        .select(
            "archive",
            "station_id",
            F.col("only.name_key").alias("only_key"),
            F.col("only.station_name").alias("only_name"),
        )
    )
    recovered = ~has_real_name(F.col("name_key")) & F.col("only_key").isNotNull()
    return (
        join_needed(obs, single, ["archive", "station_id"], ~has_real_name(F.col("name_key")), frozenset())
        .withColumn("original_station_name", F.col("station_name"))
        .withColumn("name_recovered", recovered)
        .withColumn("station_name", F.when(recovered, F.col("only_name")).otherwise(F.col("station_name")))
        .withColumn("name_key", F.when(recovered, F.col("only_key")).otherwise(F.col("name_key")))
        .drop("only_key", "only_name")
    )


def with_exclusion(obs: DataFrame) -> DataFrame:
    """Adds ``reason``: why a row cannot be resolved, or NULL."""
    key = F.col("name_key")
    return obs.withColumn(
        "reason",
        exclusion_reason(F.col("valid_endpoint_count"), F.col("first_at"), key, is_placeholder(key)),
    )


def split_excluded(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded)."""
    judged = with_exclusion(obs)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")
