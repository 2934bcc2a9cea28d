"""Coordinates: box and grid predicates, distances, cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from placetrace.params import DEFAULT, EARTH_RADIUS_METRES, Box, Rules

METRES_PER_DEGREE = math.pi * EARTH_RADIUS_METRES / 180.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on a sphere; NULL when a coordinate is."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (
        half_lon * half_lon
    )
    root = F.sqrt(h)
    # least() skips NULLs, so the clamp is written as a branch.
    return 2 * EARTH_RADIUS_METRES * F.asin(F.when(root > 1, F.lit(1.0)).otherwise(root))


def in_box(lat: Column, lon: Column, box: Box = DEFAULT.box) -> Column:
    inside = lat.between(box.lat_min, box.lat_max) & lon.between(box.lon_min, box.lon_max)
    return F.coalesce(inside, F.lit(False))


def is_coarse(lat: Column, lon: Column, rules: Rules = DEFAULT) -> Column:
    """Both coordinates lie on the two-decimal grid."""


    def near_grid(value: Column) -> Column:
        # rint() compiles to one instruction; round() would go through decimals.
        return F.abs(value - F.rint(value * 100) / 100) < rules.coarse_tolerance

    return F.coalesce(near_grid(lat) & near_grid(lon), F.lit(False))


def cell_gap_metres(
    coarse_lat: Column, coarse_lon: Column, lat: Column, lon: Column, rules: Rules = DEFAULT
) -> Column:
    """Distance from a point to the nearest point of a rounding cell."""
    half = rules.coarse_half_cell
    near_lat = F.greatest(coarse_lat - half, F.least(lat, coarse_lat + half))
    near_lon = F.greatest(coarse_lon - half, F.least(lon, coarse_lon + half))
    return haversine(near_lat, near_lon, lat, lon)


def coarse_cell_contains(
    coarse_lat: Column,
    coarse_lon: Column,
    coordinate_count: Column,
    lat: Column,
    lon: Column,
    rules: Rules = DEFAULT,
) -> Column:
    """A coarse-only row accepts points within tolerance of its cell; others accept all."""
    free = coarse_lat.isNull() | (F.coalesce(coordinate_count, F.lit(0)) > 0)
    gap = cell_gap_metres(coarse_lat, coarse_lon, lat, lon, rules)
    return free | (gap <= rules.match_metres)


def lat_side(metres: float) -> float:
    """Height in degrees of rows of cells such that points within ``metres`` are in adjacent rows."""
    return metres * 1.001 / METRES_PER_DEGREE


def cells_around(row: Column, side: float, metres: float) -> Column:
    """Into how many cells a row is cut so that points within ``metres`` lie in adjacent ones.

    Exact at every latitude: the widest gap in longitude follows from the
    haversine formula at the highest latitude of the row and its neighbours.  A
    row near a pole is one cell.
    """
    highest = F.least(F.lit(90.0), F.greatest(F.abs(row - 1), F.abs(row + 2)) * side)
    ratio = math.sin(min(metres * 1.001 / (2 * EARTH_RADIUS_METRES), math.pi / 2)) / F.cos(F.radians(highest))
    gap = F.when(ratio < 1, F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))))
    return F.coalesce(F.greatest(F.lit(1), F.floor(F.lit(359.99) / gap)), F.lit(1)).cast("long")


def cell_around(lon: Column, count: Column) -> Column:
    """Cell of a longitude in a row of ``count`` cells; 180 and -180 are one meridian."""
    turned = F.pmod(lon + 180.0, F.lit(360.0)) / 360.0
    return F.least(F.floor(turned * count).cast("long"), count - 1)


def adjacent_cells(lon: Column, count: Column) -> Column:
    """That cell and its neighbours around the globe, each once."""
    middle = cell_around(lon, count)
    return F.array_distinct(F.array(middle, F.pmod(middle - 1, count), F.pmod(middle + 1, count)))


def cell(value: Column, side: float) -> Column:
    return F.floor(value / side).cast("long")


def neighbours(value: Column, side: float, reach: int = 1) -> Column:
    middle = cell(value, side)
    return F.sequence(middle - reach, middle + reach)
