"""A boundary as a table of edges, from GeoJSON or from ring points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RING = "array<array<double>>"
_FEATURE = (
    "struct<geometry:struct<type:string,coordinates:string>>"
)


def edges_from_rings(points: DataFrame) -> DataFrame:
    """Closed edges of rings given as points (polygon, ring, place, x, y).

    The window holds one ring at a time.
    """
    ring = Window.partitionBy("polygon", "ring").orderBy("place")
    whole = Window.partitionBy("polygon", "ring").orderBy("place").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    edges = points.select(
        "polygon",
        "ring",
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        F.coalesce(F.lead("x").over(ring), F.first("x").over(whole)).alias("x2"),
        F.coalesce(F.lead("y").over(ring), F.first("y").over(whole)).alias("y2"),
    )
    return edges.filter("x1 <> x2 OR y1 <> y2")


def read_boundary(spark: SparkSession, path: str) -> DataFrame:
    """Edges of every polygon of a GeoJSON feature collection.

    Coordinates are read as text first because Polygon and MultiPolygon nest
    differently; a place is inside when it is inside any polygon.
    """
    raw = spark.read.schema(f"features array<{_FEATURE}>").json(path, multiLine=True)
    features = raw.select(F.posexplode("features").alias("feature", "f")).select(
        "feature",
        F.col("f.geometry.type").alias("type"),
        F.col("f.geometry.coordinates").alias("text"),
    )
    many = F.from_json("text", f"array<array<{_RING}>>")
    one = F.array(F.from_json("text", f"array<{_RING}>"))
    polygons = features.select(
        "feature",
        F.posexplode(F.when(F.col("type") == "MultiPolygon", many).otherwise(one)).alias(
            "part", "rings"
        ),
    )
    rings = polygons.select(
        F.concat_ws("-", "feature", "part").alias("polygon"),
        F.posexplode("rings").alias("ring", "points"),
    )
    points = rings.select("polygon", "ring", F.posexplode("points").alias("place", "point"))
    return edges_from_rings(
        points.select(
            "polygon",
            "ring",
            "place",
            F.element_at("point", 1).alias("x"),
            F.element_at("point", 2).alias("y"),
        )
    )
