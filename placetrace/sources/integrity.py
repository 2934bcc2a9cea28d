"""Inventory, content checks and the manifest of raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placetrace.operators.joins import require_none
from placetrace.operators.members import compare_manifest, is_data_table, is_readable_table, previous_copy
from placetrace.operators.normalize import table_kind
from placetrace.session import checkpoint
from placetrace.sources import files

DIGESTS = "size long, md5 string, sha256 string"


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(key, bytes, is_data_table) of every file; contents are not read."""
    listed = files.listing(spark, root)
    return listed.select("key", "bytes", is_data_table(F.col("key")).alias("is_data_table"))


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """(key, bytes, md5, sha256).  A file is hashed by one task, in blocks."""
    hashed = files.each_file(files.listing(spark, root).select("key", "path"), files.digests, DIGESTS)
    return hashed.select("key", F.col("size").alias("bytes"), "md5", "sha256")


def duplicates(found: DataFrame, positions: DataFrame) -> DataFrame:
    """Adds ``duplicate_of``: the latest earlier file with the same content.

    ``positions`` gives every key its place in the manifest.
    """
    return previous_copy(found.join(positions, "key"), ["sha256"], "position", "key", "duplicate_of")


def require_integrity(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Status of every file; raises when one is missing, unlisted or different."""
    status = compare_manifest(checkpoint(fingerprints(spark, root)), manifest)
    require_none(status.filter("status <> 'ok'").select("key", "status"), "files differ from the manifest")
    return status


def with_headers(spark: SparkSession, tables: DataFrame) -> DataFrame:
    """Adds ``headers`` and ``kind`` to files (key, path and others) that the text reader can decode."""
    framed = F.lower("path").rlike("(" + "|".join(rf"\{s}" for s in files.FRAMED) + ")$")

    def read(path):
        headers = files.read_header(path)
        return headers, table_kind(tuple(headers))

    schema = "headers array<string>, kind string"
    found = files.each_file(tables.filter(~framed), read, schema)
    rare = tables.filter(framed).select("path").collect()
    if not rare:
        return found
    headers = [(row.path, files.driver_header(spark, row.path)) for row in rare]
    named = spark.createDataFrame([(p, h, table_kind(tuple(h))) for p, h in headers], f"path string, {schema}")
    return found.unionByName(tables.filter(framed).join(named, "path").select(*found.columns))


def manifest(spark: SparkSession, root: str, hash_all: bool = False) -> DataFrame:
    """One row per data table below ``root``; it drives what is read.

    key, path, archive (folder), member (file), bytes, modified, headers, kind,
    sha256 and ``duplicate_of``, the latest earlier key with the same content.
    Copies have equal sizes, so only files that share their size are hashed
    unless ``hash_all`` is set.  Raises when a table cannot be decoded.
    """
    listed = checkpoint(files.listing(spark, root).filter(is_data_table(F.col("path"))))
    unreadable = listed.filter(~is_readable_table(F.col("path"))).orderBy("path").limit(5).collect()
    if unreadable:
        raise ValueError(f"some data tables cannot be read, such as {[row.path for row in unreadable]}")
    same_size = listed.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bytes")
    hashed = listed.select("key", "path") if hash_all else listed.join(same_size, "bytes", "left_semi").select("key", "path")
    hashed = checkpoint(files.each_file(checkpoint(hashed), files.digests, DIGESTS).select("key", "sha256"))
    steps = F.split("path", "/")
    rows = with_headers(spark, listed).join(hashed, "key", "left")
    # As many rows as files, which the listing holds on the driver anyway.
    earlier = F.lag("key").over(Window.partitionBy("sha256").orderBy("key"))
    return checkpoint(
        rows.select(
            "key",
            "path",
            F.element_at(steps, -2).alias("archive"),
            F.element_at(steps, -1).alias("member"),
            *["bytes", "modified", "headers", "kind", "sha256"],
            F.when(F.col("sha256").isNotNull(), earlier).alias("duplicate_of"),
        )
    )
