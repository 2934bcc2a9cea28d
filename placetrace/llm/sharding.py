"""Proportional stratified interleaving of documents into shards.

Rows are shuffled by a seeded hash within their source and get the fractional
rank (rank + phase) / rows of the source, with a phase of each source's own from
the same hash.  Sorted by it, every stretch of the order has the mixture of the
whole; it is cut into shards of equal counts (law ``rows``).  Ranks are found in
buckets, so a source of any share is spread over tasks.

Edge cases: a null source is a source of its own; a null text has size 8 and the
CRC of no bytes; null ids are placed like any other; repeated rows are placed
each, ties in every column being exchangeable; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.llm.ranks import rank_within, seeded
from placetrace.llm.tables import stored


def shards(docs: DataFrame, n_shards: int = 24, seed: int = 7) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    source = F.col("source").cast("string")
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("stratum"),
        ).withColumn("shuffle", seeded(seed, "doc_id", "text_crc32"))
    )
    total = rows.count()
    placed = rank_within(rows, ["stratum"], "shuffle", ["doc_id", "text_crc32", "size"], total, "rank")
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("rows"))
    placed = placed.join(sizes, "stratum").withColumn(
        "fraction", (F.col("rank") + seeded(seed, "stratum")) / F.col("rows")
    )
    placed = rank_within(stored(placed), [], "fraction", ["stratum", "rank"], total, "place")
    shard = F.floor(F.col("place") * n_shards / F.lit(max(total, 1)))
    first = F.ceil(F.col("shard") * F.lit(total) / F.lit(n_shards)).cast("long")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("place") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
