"""Distance joins over grid cells, and points against a boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.functions.geo import adjacent_cells, cell, cell_around, cells_around, haversine, lat_side, neighbours
from placetrace.operators.joins import PAIR_BLOCK, split_join, spread
from placetrace.session import checkpoint

# Side of the cells of the boundary, in degrees, and how much wider an edge is taken than it is.
BAND = 0.01
SLACK = 1e-9


def distance_join(
    a: DataFrame,
    b: DataFrame,
    metres: float,
    a_id: str,
    b_id: str,
    keys: Sequence[str] = (),
    block: int = PAIR_BLOCK,
) -> DataFrame:
    """Rows of ``a`` and ``b`` within ``metres`` (and equal ``keys``).

    Both sides carry ``lat`` and ``lon``, anywhere on the globe.  Each ``b`` row is
    copied to the cells around it, at most nine, so an ``a`` row meets its
    neighbours in its own cell; the exact distance decides.  A crowded cell is split over tasks.  Both sides
    are shuffled by cell: the copies are too many to broadcast, however small the files of ``b`` are, so ``b``
    should be the side with fewer rows.  Columns come back prefixed ``a_`` and ``b_``, with ``distance_meters``.
    """
    side = lat_side(metres)
    y = F.col("__y")
    left = a.filter("lat IS NOT NULL AND lon IS NOT NULL").select(
        *[F.col(k) for k in keys],
        cell(F.col("lat"), side).alias("__y"),
        *[F.col(c).alias(f"a_{c}") for c in a.columns],
    ).withColumn("__x", cell_around(F.col("a_lon"), cells_around(y, side, metres)))
    right = (
        spread(b.filter("lat IS NOT NULL AND lon IS NOT NULL"), [b_id])
        .select(
            *[F.col(k) for k in keys],
            F.explode(neighbours(F.col("lat"), side)).alias("__y"),
            *[F.col(c).alias(f"b_{c}") for c in b.columns],
        )
        .withColumn("__x", F.explode(adjacent_cells(F.col("b_lon"), cells_around(y, side, metres))))
    )
    gap = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    joined = split_join(
        left, right, [*keys, "__y", "__x"], [f"a_{a_id}"], condition=gap <= metres, block=block, shuffled=True
    )
    return joined.withColumn("distance_meters", gap).drop("__y", "__x", *keys)


def _cells(lat, lon):
    return F.floor(lat / BAND).cast("long").alias("band"), F.floor(lon / BAND).cast("long").alias("column")


def edge_cells(edges: DataFrame) -> DataFrame:
    """(band, column) of every grid cell that an edge touches."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    bands = edges.withColumn(
        "band", F.explode(F.sequence(F.floor(low / BAND).cast("long"), F.floor(high / BAND).cast("long")))
    )

    def at(y):
        """Where the edge is at a height within its own."""
        held = F.least(F.greatest(y, low), high)
        return F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(
            F.col("x1") + (F.col("x2") - F.col("x1")) * (held - F.col("y1")) / (F.col("y2") - F.col("y1"))
        )

    below, above = at(F.col("band") * BAND), at((F.col("band") + 1) * BAND)
    flat = F.col("y1") == F.col("y2")
    left = F.when(flat, F.least("x1", "x2")).otherwise(F.least(below, above)) - SLACK
    right = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(below, above)) + SLACK
    columns = F.sequence(F.floor(left / BAND).cast("long"), F.floor(right / BAND).cast("long"))
    return bands.select("band", F.explode(columns).alias("column")).distinct()


def _inside(spots: DataFrame, edges: DataFrame, block: int) -> DataFrame:
    """The distinct spots (lat, lon) that lie in a polygon or on its edge, by the edges of their latitude band."""
    banded = edges.withColumn(
        "band",
        F.explode(
            F.sequence(
                F.floor(F.least("y1", "y2") / BAND).cast("long"),
                F.floor(F.greatest("y1", "y2") / BAND).cast("long"),
            )
        ),
    )
    placed = spots.withColumn("band", F.floor(F.col("lat") / BAND).cast("long"))
    x, y = F.col("lon"), F.col("lat")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    spans = (y1 > y) != (y2 > y)
    # Guarded: a horizontal edge never spans, but its division must not fail.
    run = F.when(y1 != y2, (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    crosses = spans & (x < run)
    on_edge = (
        ((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1))
        & x.between(F.least(x1, x2), F.greatest(x1, x2))
        & y.between(F.least(y1, y2), F.greatest(y1, y2))
    )
    per_polygon = (
        split_join(placed, banded, ["band"], ["lat", "lon"], block=block)
        .groupBy("lat", "lon", "polygon")
        .agg(F.count_if(crosses).alias("crossings"), F.max(on_edge).alias("touches"))
    )
    return per_polygon.filter((F.col("crossings") % 2 == 1) | F.col("touches")).select("lat", "lon").distinct()


def point_in_boundary(points: DataFrame, edges: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """Adds ``in_city``: inside or on the boundary; NULL without a point.

    A point is inside a polygon when a ray crosses its rings an odd number of
    times (holes are rings too), or when it lies on an edge.  A grid cell that no
    edge touches lies inside or outside as a whole, so its middle answers for all
    of its points; only points of the other cells meet edges themselves.  Those of
    a crowded latitude band are split over tasks.
    """
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    spots = points.filter(located).select("lat", "lon").distinct().select("*", *_cells(F.col("lat"), F.col("lon")))
    spots = checkpoint(spots.join(edge_cells(edges).withColumn("edged", F.lit(True)), ["band", "column"], "left"))
    middle = [((F.col(c) + 0.5) * BAND).alias(name) for c, name in (("band", "lat"), ("column", "lon"))]
    whole = spots.filter("edged IS NULL").select("band", "column").distinct()
    answers = whole.select("band", "column", *middle)
    asked = spots.filter("edged").select("lat", "lon").unionByName(answers.select("lat", "lon"))
    yes = checkpoint(_inside(asked, edges, block).withColumn("__inside", F.lit(True)))
    cells = answers.join(yes, ["lat", "lon"]).select("band", "column", "__inside")
    inside = (
        spots.filter("edged").join(yes, ["lat", "lon"])
        .select("lat", "lon", "__inside")
        .unionByName(spots.filter("edged IS NULL").join(cells, ["band", "column"]).select("lat", "lon", "__inside"))
    )
    return (
        points.join(inside, ["lat", "lon"], "left")
        .withColumn("in_city", F.when(located, F.coalesce("__inside", F.lit(False))))
        .drop("__inside")
    )
