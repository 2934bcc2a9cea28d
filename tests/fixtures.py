"""Small rows with defaults."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

OBSERVATION = (
    "station_id string, station_name string, original_station_name string, name_key string,"
    " lat double, lon double, role string, endpoint_count bigint, valid_endpoint_count bigint,"
    " coordinate_count bigint, coarse_coordinate_count bigint, coarse_lat double, coarse_lon double,"
    " lat_p05 double, lat_p95 double, lon_p05 double, lon_p95 double,"
    " first_at timestamp_ntz, last_at timestamp_ntz, first_trip_id string, archive string,"
    " member string, schema string, coordinate_source string, coordinate_source_archive string,"
    " coordinate_inferred boolean, coordinate_rejected boolean, name_recovered boolean"
)
COLUMNS = [part.split()[0] for part in OBSERVATION.split(", ")]


def observation(station_id, name, lat=None, lon=None, **more) -> dict:
    row = {
        "station_id": station_id,
        "station_name": name,
        "original_station_name": name,
        "name_key": (name or "").lower(),
        "lat": lat,
        "lon": lon,
        "role": "start",
        "endpoint_count": 20,
        "valid_endpoint_count": 20,
        "coordinate_count": 20 if lat is not None else 0,
        "coarse_coordinate_count": 0,
        "first_at": datetime(2020, 1, 1),
        "last_at": datetime(2020, 1, 2),
        "first_trip_id": "000123",
        "archive": "a.zip",
        "member": "a.csv",
        "schema": "modern",
        "coordinate_source": "trip_endpoint_median" if lat is not None else "missing",
        "coordinate_source_archive": "a.zip",
        "coordinate_inferred": False,
        "coordinate_rejected": False,
        "name_recovered": False,
    }
    return row | more


def observations(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], OBSERVATION)


def rectangle(spark: SparkSession) -> DataFrame:
    from placetrace.sources.boundary import edges_from_rings

    corners = [(-88.0, 41.0), (-87.0, 41.0), (-87.0, 43.0), (-88.0, 43.0)]
    rows = [("box", 0, i, x, y) for i, (x, y) in enumerate(corners)]
    return edges_from_rings(
        spark.createDataFrame(rows, "polygon string, ring int, place int, x double, y double")
    )


CATALOG = (
    "station_id string, station_name string, lat double, lon double,"
    " reported_online_at timestamp_ntz, reported_created_at timestamp_ntz, archive string, member string"
)


def catalog(spark: SparkSession, rows: list[tuple] = ()) -> DataFrame:
    return spark.createDataFrame(list(rows), CATALOG)
