"""From clustered observations to entities.

The picks (first event, latest identity, representative coordinate) are minima
and maxima of structs: they combine on the map side, where a window would bring
all rows of an entity to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetrace.functions.geo import haversine, in_box
from placetrace.functions.rules import coordinate_month, flags_where
from placetrace.functions.text import (
    display_name,
    entity_class,
    is_operational,
    join_list,
    normalize_name,
)
from placetrace.functions.times import month_text
from placetrace.operators.spatial import point_in_boundary
from placetrace.params import DEFAULT, Rules


def first_event() -> Column:
    """Earliest observation: time, trip id, role, archive, member."""
    return F.min(
        F.struct(
            "first_at",
            F.coalesce("first_trip_id", F.lit("")).alias("id_order"),
            "role",
            "archive",
            "member",
            "first_trip_id",
        )
    )


def latest_identity() -> Column:
    """Newest id and name; rows with an id go before those without."""
    return F.max(
        F.struct(
            F.col("station_id").isNotNull().alias("has_id"),
            "last_at",
            "valid_endpoint_count",
            F.coalesce("station_id", F.lit("")).alias("id_order"),
            "station_name",
            "station_id",
        )
    )


def best_coordinate(rules: Rules = DEFAULT) -> Column:
    """Well-supported arrivals of the newest month, else the newest located row."""
    located = in_box(F.col("lat"), F.col("lon"), rules.box)
    reliable = (F.col("coordinate_count") >= rules.min_reliable_coordinates) & (
        F.col("role") == "end"
    )
    return F.max(
        F.when(
            located,
            F.struct(
                reliable.alias("reliable"),
                month_text(F.col("last_at")).alias("month"),
                "coordinate_count",
                "last_at",
                "archive",
                "member",
                "role",
                F.coalesce("station_id", F.lit("")).alias("id_order"),
                "lat",
                "lon",
                "coordinate_source",
                "coordinate_source_archive",
            ),
        )
    )


def online_dates(clustered: DataFrame, catalog: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Reported online dates per entity: earliest, latest, number of days.

    A catalog row counts when its id and its name both occur in the entity and
    it is near the anchor, or one of the two has no location.
    """
    anchor = ["anchor_lat", "anchor_lon"]
    ids = clustered.filter("station_id IS NOT NULL").select("station_key", *anchor, "station_id").distinct()
    names = clustered.select("station_key", "name_key").distinct()
    dated = (
        catalog.filter("reported_online_at IS NOT NULL AND station_id IS NOT NULL")
        .withColumn("name_key", normalize_name(F.col("station_name")))
        .select("station_id", "name_key", "lat", "lon", "reported_online_at")
    )
    no_point = ~in_box(F.col("lat"), F.col("lon"), rules.box)
    gap = haversine(F.col("lat"), F.col("lon"), F.col("anchor_lat"), F.col("anchor_lon"))
    near = F.col("anchor_lat").isNull() | no_point | (gap <= rules.match_metres)
    # Every id with every name of an entity, then one join on both: a catalog row
    # meets only the entities it belongs to, however often its id is reused.
    return (
        ids.join(names, "station_key")
        .join(dated, ["station_id", "name_key"])
        .filter(near)
        .groupBy("station_key")
        .agg(
            F.min("reported_online_at").alias("reported_online_at"),
            F.max("reported_online_at").alias("reported_online_at_latest"),
            F.countDistinct(F.to_date("reported_online_at")).alias("online_days"),
        )
    )


def summarize_entities(
    clustered: DataFrame,
    catalog: DataFrame | None = None,
    boundary: DataFrame | None = None,
    rules: Rules = DEFAULT,
    extra_flags: Sequence[str] = (),
) -> DataFrame:
    """One row per ``station_key``.

    ``key_name`` (the name key of the cluster) defaults to ``name_key``; boolean
    columns named in ``extra_flags`` become quality flags when any row has them.
    """
    if "key_name" not in clustered.columns:
        clustered = clustered.withColumn("key_name", F.col("name_key"))

    def any_row(condition: Column) -> Column:
        return F.max(F.coalesce(condition, F.lit(False)))

    source = F.col("coordinate_source")
    role = F.col("role")
    groups = clustered.groupBy("station_key").agg(
        F.min("key_name").alias("name_key"),
        F.min("anchor_lat").alias("anchor_lat"),
        F.min("anchor_lon").alias("anchor_lon"),
        first_event().alias("first"),
        latest_identity().alias("latest"),
        best_coordinate(rules).alias("spot"),
        F.min(F.when(role == "start", F.col("first_at"))).alias("station_first_departure_at"),
        F.min(F.when(role == "end", F.col("first_at"))).alias("station_first_arrival_at"),
        F.max("last_at").alias("station_last_trip_at"),
        F.sum("valid_endpoint_count").alias("endpoint_count"),
        F.sum("coarse_coordinate_count").alias("coarse_coordinate_endpoint_count"),
        F.array_sort(F.collect_set("station_id")).alias("ids"),
        F.array_sort(F.collect_set("station_name")).alias("names"),
        any_row(F.col("ambiguous")).alias("is_ambiguous"),
        any_row(F.col("coordinate_inferred")).alias("is_inferred"),
        any_row(source == "historical_lookup_id_only").alias("by_id_only"),
        any_row(F.col("coordinate_rejected")).alias("is_scattered"),
        any_row(F.col("coarse_coordinate_count") > 0).alias("has_coarse"),
        any_row(source.startswith("current_feed_")).alias("from_feed"),
        any_row(F.col("name_recovered")).alias("has_recovered"),
        *[any_row(F.col(name)).alias(f"__{name}") for name in extra_flags],
    )
    if catalog is not None:
        groups = groups.join(online_dates(clustered, catalog, rules), "station_key", "left")
    else:
        groups = groups.withColumns(
            {
                "reported_online_at": F.lit(None).cast("timestamp_ntz"),
                "reported_online_at_latest": F.lit(None).cast("timestamp_ntz"),
                "online_days": F.lit(None).cast("long"),
            }
        )
    groups = groups.withColumn("lat", F.col("spot.lat")).withColumn("lon", F.col("spot.lon"))
    if boundary is not None:
        groups = point_in_boundary(groups, boundary)
    else:
        groups = groups.withColumn("in_city", F.lit(None).cast("boolean"))
    operational = is_operational(F.col("name_key"), F.col("ids"), rules)
    flags = flags_where(
        fewer_than_10_endpoints=F.col("endpoint_count") < rules.min_evidence,
        missing_coordinates=F.col("spot").isNull(),
        ambiguous_historical_location=F.col("is_ambiguous"),
        historical_location_inferred=F.col("is_inferred"),
        historical_coordinates_matched_by_id=F.col("by_id_only"),
        scattered_gps_rejected=F.col("is_scattered"),
        coarse_trip_coordinates_not_used=F.col("has_coarse"),
        location_inferred_from_current_feed=F.col("from_feed"),
        missing_name_recovered=F.col("has_recovered"),
        multiple_source_ids=F.size("ids") > 1,
        missing_source_id=F.size("ids") == 0,
        first_archive_day=F.to_date("first.first_at") == F.lit(rules.first_archive_day).cast("date"),
        operational_station=operational,
        conflicting_reported_online_dates=F.coalesce(F.col("online_days") > 1, F.lit(False)),
        **{name: F.col(f"__{name}") for name in extra_flags},
    )
    spot_source = F.coalesce(F.col("spot.coordinate_source"), F.lit("missing"))
    return groups.select(
        "station_key",
        F.col("latest.station_id").alias("station_id"),
        display_name(F.col("latest.station_name")).alias("station_name"),
        F.col("lon").alias("station_lon"),
        F.col("lat").alias("station_lat"),
        F.col("first.first_at").alias("station_first_trip_at"),
        "station_first_departure_at",
        "station_first_arrival_at",
        "station_last_trip_at",
        "reported_online_at",
        "reported_online_at_latest",
        "in_city",
        entity_class(F.col("name_key"), F.col("ids"), rules).alias("station_type"),
        "endpoint_count",
        "coarse_coordinate_endpoint_count",
        F.size("ids").cast("long").alias("source_id_count"),
        join_list(F.col("ids")).alias("source_ids"),
        join_list(F.col("names")).alias("name_variants"),
        join_list(F.array_sort(flags)).alias("quality_flags"),
        F.col("first.first_trip_id").alias("first_trip_id"),
        F.col("first.role").alias("first_trip_role"),
        F.col("first.archive").alias("first_trip_archive"),
        F.col("first.member").alias("first_trip_member"),
        spot_source.alias("coordinate_source"),
        F.when(
            F.col("spot").isNotNull(), coordinate_month(spot_source, F.col("spot.month"))
        ).alias("coordinate_observed_month"),
        F.col("spot.coordinate_source_archive").alias("coordinate_source_archive"),
        "name_key",
        "anchor_lat",
        "anchor_lon",
    )


def first_trip(entities: DataFrame, obs: DataFrame) -> DataFrame:
    """The published query: each entity with the minimum over its observations."""
    first = obs.groupBy("station_key").agg(F.min("first_at").alias("station_first_trip_at"))
    return (
        entities.drop("station_first_trip_at")
        .join(first, "station_key")
        .select(
            "station_key",
            "station_id",
            "station_name",
            "station_lon",
            "station_lat",
            "station_first_trip_at",
            "quality_flags",
        )
        .orderBy(F.asc_nulls_last("station_first_trip_at"), "station_key")
    )


def public_entities(entities: DataFrame) -> DataFrame:
    inside = F.coalesce(F.col("in_city"), F.lit(False))
    return entities.filter(inside & (F.col("station_type") != "operational"))
