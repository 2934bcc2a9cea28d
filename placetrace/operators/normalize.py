"""From text columns of any header family to canonical trips and catalog rows."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetrace.functions.text import clean
from placetrace.functions.times import parse_double, parse_timestamp

# Header spellings of each canonical field, first match wins. ---
TRIP_HEADERS = {
    "trip_id": ("ride_id", "trip_id", "01 - Rental Details Rental ID"),
    "started_at": (
        "started_at",
        "starttime",
        "start_time",
        "01 - Rental Details Local Start Time",
    ),
    "ended_at": ("ended_at", "stoptime", "end_time", "01 - Rental Details Local End Time"),
    "start_station_id": (
        "start_station_id",
        "from_station_id",
        "03 - Rental Start Station ID",
    ),
    "start_station_name": (
        "start_station_name",
        "from_station_name",
        "03 - Rental Start Station Name",
    ),
    "end_station_id": ("end_station_id", "to_station_id", "02 - Rental End Station ID"),
    "end_station_name": (
        "end_station_name",
        "to_station_name",
        "02 - Rental End Station Name",
    ),
}
TRIP_COORDINATES = {
    "start_lat": "start_lat",
    "start_lon": "start_lng",
    "end_lat": "end_lat",
    "end_lon": "end_lng",
}
CATALOG_HEADERS = {
    "station_id": ("id", "station_id"),
    "station_name": ("name", "station_name"),
    "lat": ("latitude", "lat"),
    "lon": ("longitude", "lon", "long"),
}
CATALOG_DATES = {"reported_online_at": "onlinedate", "reported_created_at": "datecreated"}
# ----------------------------------------------------------------------------

TIMES = {"started_at", "ended_at"}


def squash(header: str) -> str:
    return re.sub(r"[^a-z0-9]", "", header.lower())


def resolve_headers(
    headers: Sequence[str], aliases: Mapping[str, Sequence[str]]
) -> dict[str, str]:
    """Canonical field -> header of this table; a field without a header raises."""
    present = {squash(header): header for header in headers}
    found = {}
    for field, spellings in aliases.items():
        hits = [present[squash(s)] for s in spellings if squash(s) in present]
        if not hits:
            raise ValueError(f"no column for {field}: expected one of {spellings} in {headers}")
        found[field] = hits[0]
    return found


def table_kind(headers: Sequence[str]) -> str:
    """'modern' or 'legacy' for trips, 'station_lookup' for catalogs."""
    if "ride_id" in headers:
        return "modern"
    return "legacy" if set(TRIP_HEADERS["trip_id"]) & set(headers) else "station_lookup"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def lineage_columns(df: DataFrame) -> list[str]:
    return [name for name in ("archive", "member") if name in df.columns]


def normalize_trips(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Canonical trips from text columns; lineage columns are kept.

    Legacy families carry no coordinates: theirs are NULL.
    """
    mapping = mapping or resolve_headers(df.columns, TRIP_HEADERS)
    kind = table_kind(df.columns)
    fields = [
        (parse_timestamp if field in TIMES else clean)(quoted(header)).alias(field)
        for field, header in mapping.items()
    ]
    for field, header in TRIP_COORDINATES.items():
        value = parse_double(quoted(header)) if kind == "modern" else F.lit(None).cast("double")
        fields.append(value.alias(field))
    return df.select(*fields, F.lit(kind).alias("schema"), *lineage_columns(df))


def normalize_catalog(df: DataFrame) -> DataFrame:
    mapping = resolve_headers(df.columns, CATALOG_HEADERS)
    present = {squash(header): header for header in df.columns}
    fields = [
        (parse_double if field in ("lat", "lon") else clean)(quoted(header)).alias(field)
        for field, header in mapping.items()
    ]
    for field, key in CATALOG_DATES.items():
        value = (
            parse_timestamp(quoted(present[key]))
            if key in present
            else F.lit(None).cast("timestamp_ntz")
        )
        fields.append(value.alias(field))
    return df.select(*fields, *lineage_columns(df))


def union_trips(tables: Sequence[DataFrame]) -> DataFrame:
    """One trips table from tables of different header families."""
    trips = [normalize_trips(table) for table in tables]
    out = trips[0]
    for other in trips[1:]:
        out = out.unionByName(other)
    return out
