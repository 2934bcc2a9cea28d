"""Current inventory snapshots: JSON arrays, nested lists, pinned content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrace.operators.joins import require_none
from placetrace.sources.integrity import fingerprints

INFORMATION = (
    "station_id string, name string, short_name string, lat double, lon double,"
    " station_type string, capacity int"
)
STATUS = "station_id string, is_installed int, is_renting int, is_returning int"


def read_city(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects; unknown fields are kept and every scalar stays text."""
    return spark.read.option("primitivesAsString", "true").json(path, multiLine=True)


def read_stations(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The rows of ``data.stations`` under an explicit schema."""
    names = [part.split()[0] for part in fields.split(",")]
    types = ",".join(f"{p.split()[0]}:{p.split()[1]}" for p in fields.split(","))
    raw = spark.read.schema(f"data struct<stations:array<struct<{types}>>>").json(path, multiLine=True)
    rows = raw.select(F.explode("data.stations").alias("s"))
    return rows.select(*[F.col(f"s.{name}").alias(name) for name in names])


def read_information(spark: SparkSession, path: str) -> DataFrame:
    return read_stations(spark, path, INFORMATION)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return read_stations(spark, path, STATUS)


def declared_columns(spark: SparkSession, path: str) -> list[dict]:
    """Declared fields of the city inventory: a handful of names for the driver."""
    schema = "columns array<struct<fieldName:string,name:string,position:int>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("columns"))
    return [row.asDict() for row in rows.collect()]


def require_pinned(spark: SparkSession, root: str, manifest: DataFrame) -> None:
    """Raise unless every pinned file (path below ``root``, sha256) has exactly that content."""
    found = fingerprints(spark, root).select(F.col("key").alias("pinned_path"), F.col("sha256").alias("found"))
    wrong = (
        manifest.select(F.col("path").alias("pinned_path"), "sha256")
        .join(found, "pinned_path", "left")
        .filter(~F.col("found").eqNullSafe(F.col("sha256")))
        .select("pinned_path", "sha256", "found")
    )
    require_none(wrong, "feed hash mismatch")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source, path, sha256, retrieved_at) of a manifest ``{"sources": {name: {...}}}``."""
    entry = "struct<path:string,sha256:string,retrieved_at:string>"
    raw = spark.read.schema(f"sources map<string,{entry}>").json(path, multiLine=True)
    return raw.select(F.explode("sources").alias("source", "s")).select(
        "source", "s.path", "s.sha256", "s.retrieved_at"
    )
