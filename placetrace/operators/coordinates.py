"""Coordinates of observations: scatter test, catalogs, arrivals, current feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.functions.geo import coarse_cell_contains, haversine, in_box
from placetrace.functions.text import normalize_name
from placetrace.operators.joins import join_needed, join_null_safe
from placetrace.params import DEFAULT, Rules
from placetrace.session import checkpoint_large


def reject_scattered(obs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Drop a median whose 5 % and 95 % corners lie too far apart."""
    spread = haversine(F.col("lat_p05"), F.col("lon_p05"), F.col("lat_p95"), F.col("lon_p95"))
    scattered = F.coalesce(F.col("coordinate_dispersion_meters") > rules.max_dispersion_metres, F.lit(False))
    return (
        obs.withColumn("coordinate_dispersion_meters", spread)
        .withColumn("coordinate_rejected", scattered)
        .withColumn("lat", F.when(~F.col("coordinate_rejected"), F.col("lat")))
        .withColumn("lon", F.when(~F.col("coordinate_rejected"), F.col("lon")))
    )


def catalog_spots(catalog: DataFrame, keys: list[str], rules: Rules = DEFAULT) -> DataFrame:
    """One row per key: the newest catalog point, and whether all snapshots agree.

    Agreement is measured from the oldest snapshot.  Both ends come from one
    aggregate; the distances need one join back, on the same keys.
    """
    located = catalog.filter(in_box(F.col("lat"), F.col("lon"), rules.box))
    spot = F.struct("archive", "member", "lat", "lon")
    ends = located.groupBy(*keys).agg(F.min(spot).alias("oldest"), F.max(spot).alias("newest"))
    gap = haversine(F.col("oldest.lat"), F.col("oldest.lon"), F.col("lat"), F.col("lon"))
    return (
        join_null_safe(located.select(*keys, "lat", "lon"), ends, keys, "inner")
        .groupBy(*keys)
        .agg(F.max(gap).alias("gap"), F.max("newest").alias("newest"))
        .select(
            *keys,
            F.when(F.col("gap") <= rules.match_metres, F.col("newest.lat")).alias("spot_lat"),
            F.when(F.col("gap") <= rules.match_metres, F.col("newest.lon")).alias("spot_lon"),
            F.col("newest.archive").alias("spot_archive"),
            F.lit(True).alias("listed"),
        )
    )


def use_catalog(obs: DataFrame, catalog: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Fill missing coordinates from agreeing catalog snapshots.

    The pair (id, name) decides; only legacy rows whose pair is not listed at
    all may fall back to the id alone.
    """
    if "name_key" not in catalog.columns:
        catalog = catalog.withColumn("name_key", normalize_name(F.col("station_name")))
    pair = catalog_spots(catalog, ["station_id", "name_key"], rules)
    by_id = catalog_spots(catalog, ["station_id"], rules).withColumnsRenamed(
        {name: f"id_{name}" for name in ("spot_lat", "spot_lon", "spot_archive", "listed")}
    )
    # Only rows without a point of their own ask the catalogs, and only legacy ones by id.
    measured = in_box(F.col("lat"), F.col("lon"), rules.box)
    joined = join_needed(obs, pair, ["station_id", "name_key"], ~measured)
    joined = join_needed(joined, by_id, ["station_id"], ~measured & (F.col("schema") == "legacy"))
    by_pair = F.col("listed").isNotNull()
    by_id_only = ~by_pair & (F.col("schema") == "legacy")

    def pick(name: str):
        return F.when(by_pair, F.col(name)).when(by_id_only, F.col(f"id_{name}"))

    filled = ~measured & pick("spot_lat").isNotNull()
    method = F.when(by_pair, "historical_station_lookup").otherwise("historical_lookup_id_only")
    return joined.select(
        *[c for c in obs.columns if c not in ("lat", "lon")],
        F.when(filled, pick("spot_lat")).otherwise(F.col("lat")).alias("lat"),
        F.when(filled, pick("spot_lon")).otherwise(F.col("lon")).alias("lon"),
        F.when(measured, "trip_endpoint_median")
        .when(filled, method)
        .otherwise("missing")
        .alias("coordinate_source"),
        F.when(filled, pick("spot_archive"))
        .otherwise(F.col("archive"))
        .alias("coordinate_source_archive"),
        filled.alias("coordinate_inferred"),
    )


def use_arrivals(obs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Departures take the point of the arrivals in the same file, id and name."""
    keys = ["archive", "member", "station_id", "name_key"]
    usable = (
        (F.col("role") == "end")
        & (F.col("coordinate_count") >= rules.min_arrival_coordinates)
        & in_box(F.col("lat"), F.col("lon"), rules.box)
        & ~F.col("coordinate_rejected")
    )
    # Several spellings may share a key: best supported first, then by spelling.
    best = F.min(
        F.struct(
            (-F.col("coordinate_count")).alias("support"),
            "station_name",
            "lat",
            "lon",
            "coordinate_source_archive",
        )
    )
    arrivals = obs.filter(usable).groupBy(*keys).agg(best.alias("arrival"))
    joined = join_needed(obs, arrivals, keys, F.col("role") == "start")
    moved = (F.col("role") == "start") & F.col("arrival").isNotNull()
    return (
        joined.withColumn("lat", F.when(moved, F.col("arrival.lat")).otherwise(F.col("lat")))
        .withColumn("lon", F.when(moved, F.col("arrival.lon")).otherwise(F.col("lon")))
        .withColumn(
            "coordinate_source",
            F.when(moved, "same_file_arrival_median").otherwise(F.col("coordinate_source")),
        )
        .withColumn(
            "coordinate_source_archive",
            F.when(moved, F.col("arrival.coordinate_source_archive")).otherwise(
                F.col("coordinate_source_archive")
            ),
        )
        .drop("arrival")
    )


def enrich_coordinates(obs: DataFrame, catalog: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    # Rows are split by whether they have a point: stored, so that the scatter test runs once.
    return use_arrivals(use_catalog(checkpoint_large(reject_scattered(obs, rules)), catalog, rules), rules)


def fallback_catalog(information: DataFrame, city: DataFrame) -> DataFrame:
    """Operator rows, plus city rows whose id the operator does not list."""
    operator = information.select("station_id", F.col("name").alias("station_name"), "lat", "lon")
    others = city.select(
        F.col("id").alias("station_id"),
        "station_name",
        F.col("latitude").cast("double").alias("lat"),
        F.col("longitude").cast("double").alias("lon"),
    ).join(information.select("station_id"), "station_id", "left_anti")
    return operator.unionByName(others)


def recover_feed_coordinates(
    obs: DataFrame, information: DataFrame, city: DataFrame, rules: Rules = DEFAULT
) -> DataFrame:
    """Place coarse-only names by a unique current name inside the rounding cell.

    A name with any usable historical location is left to clustering.
    """
    located = in_box(F.col("lat"), F.col("lon"), rules.box)
    known = obs.filter(located).select("name_key").distinct()
    unique = (
        fallback_catalog(information, city)
        .groupBy(normalize_name(F.col("station_name")).alias("name_key"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("lat").alias("feed_lat"),
            F.min("lon").alias("feed_lon"),
        )
        .filter("rows = 1")
        .drop("rows")
        .join(known, "name_key", "left_anti")
    )
    inside = coarse_cell_contains(
        F.col("coarse_lat"),
        F.col("coarse_lon"),
        F.col("coordinate_count"),
        F.col("feed_lat"),
        F.col("feed_lon"),
        rules,
    )
    placed = F.coalesce(
        F.col("coarse_lat").isNotNull() & F.col("feed_lat").isNotNull() & inside, F.lit(False)
    )

    def either(value, name: str):
        return F.when(F.col("placed"), value).otherwise(F.col(name))

    # A name with a located row has no feed row, so such rows need not ask.
    asking = F.col("coarse_lat").isNotNull() & ~located
    return (
        join_needed(obs, unique, ["name_key"], asking)
        .withColumn("placed", placed)
        .withColumn("lat", either(F.col("feed_lat"), "lat"))
        .withColumn("lon", either(F.col("feed_lon"), "lon"))
        .withColumn(
            "coordinate_source",
            either(F.lit("current_feed_exact_name_within_coarse_cell"), "coordinate_source"),
        )
        .withColumn(
            "coordinate_source_archive",
            either(F.lit(rules.feed_archive), "coordinate_source_archive"),
        )
        .withColumn("coordinate_inferred", either(F.lit(True), "coordinate_inferred"))
        .drop("placed", "feed_lat", "feed_lon")
    )
