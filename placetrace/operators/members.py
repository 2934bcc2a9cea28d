"""Files of an archive: inventory, integrity, and copies of earlier ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Positions per block of the previous-copy search.
BLOCK = 50_000


def is_data_table(path: Column) -> Column:
    """A .csv (plain or compressed) or .xlsx file, in any case, neither hidden nor archive metadata."""
    name = F.element_at(F.split(path, "/"), -1)
    return (
        F.lower(path).rlike(r"\.(csv(\.(gz|bz2|zst|lz4|deflate|snappy|zip))?|xlsx)$")
        & ~path.contains("__MACOSX")
        & ~name.startswith(".")
    )


def is_readable_table(path: Column) -> Column:
    """A data table that the text reader can decode; the codec is told by a suffix in small letters."""
    return F.lower(path).endswith(".csv") | path.rlike(r"(?i:\.csv)\.(gz|bz2|zst|lz4|deflate|snappy)$")


def fingerprint(df: DataFrame, content: str, keys: Sequence[str]) -> DataFrame:
    """Length, MD5 and SHA-256 of a text or binary column."""
    raw = F.col(content).cast("binary")
    return df.select(
        *keys,
        F.octet_length(raw).cast("long").alias("bytes"),
        F.md5(raw).alias("md5"),
        F.sha2(raw, 256).alias("sha256"),
    )


def previous_copy(
    df: DataFrame, keys: Sequence[str], position: str, value: str, alias: str, block: int = BLOCK
) -> DataFrame:
    """Adds the value of the latest earlier row with the same keys, or NULL.

    A plain ``lag`` would bring all copies of one content to one task.  Here a
    window sees the copies within one block of positions; the first copy of a
    block looks up the last one before, among one row per content and block.
    """
    keys = list(keys)
    placed = df.withColumn("__block", F.floor(F.col(position) / block).cast("long"))
    entry = F.struct(F.col(position).alias("at"), F.col(value).alias("value"))
    per_block = placed.groupBy(*keys, "__block").agg(F.max(entry).alias("last"))
    earlier = per_block.select(
        *keys,
        "__block",
        F.lag("last").over(Window.partitionBy(*keys).orderBy("__block")).alias("__earlier"),
    )
    within = Window.partitionBy(*keys, "__block").orderBy(position)
    return (
        placed.withColumn("__near", F.lag(entry).over(within))
        .join(earlier, [*keys, "__block"])
        .withColumn(alias, F.coalesce("__near", "__earlier")["value"])
        .drop("__block", "__near", "__earlier")
    )


def compare_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status per file: ok, or how it differs from the manifest.

    ``found`` has key, bytes, md5 and sha256; the manifest has key, size, etag
    and sha256.  An etag is an MD5 only when the upload had a single part.
    """
    mine = found.select("key", F.lit(True).alias("present"), "bytes", "md5", "sha256")
    listed = manifest.select(
        "key", F.lit(True).alias("listed"), "size", "etag", F.col("sha256").alias("pinned")
    )
    single_part = ~F.col("etag").contains("-")
    status = (
        F.when(F.col("present").isNull(), "missing")
        .when(F.col("listed").isNull(), "unlisted")
        .when(F.col("bytes") != F.col("size"), "wrong_size")
        .when(single_part & (F.col("md5") != F.col("etag")), "wrong_md5")
        .when(F.col("sha256") != F.col("pinned"), "wrong_sha256")
        .otherwise("ok")
    )
    return mine.join(listed, "key", "full_outer").withColumn("status", status)
