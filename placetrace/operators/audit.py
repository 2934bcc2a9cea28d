"""Two builds compared at observation grain, and what became of each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetrace.functions.geo import is_coarse
from placetrace.functions.rules import disposition
from placetrace.operators.joins import join_null_safe
from placetrace.params import DEFAULT, Rules

# What identifies an observation in any build; ids alone are reused over time.
GRAIN = ["archive", "member", "role", "station_id", "original_station_name"]


def match_observations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new key and count of every observation found in both builds."""
    left = old.select(
        *GRAIN,
        F.col("station_key").alias("old_station_key"),
        F.col("valid_endpoint_count").alias("old_valid"),
    )
    right = new.select(
        *GRAIN,
        F.col("station_key").alias("new_station_key"),
        F.col("valid_endpoint_count").alias("new_valid"),
    )
    return join_null_safe(left, right, GRAIN, "inner")


def lineage(
    old_entities: DataFrame, new_entities: DataFrame, old_obs: DataFrame, new_obs: DataFrame
) -> DataFrame:
    """Old entity -> new entity links with their shared endpoints and disposition."""
    links = (
        match_observations(old_obs, new_obs)
        .groupBy("old_station_key", "new_station_key")
        .agg(F.sum("old_valid").alias("shared_valid_endpoints"))
    )

    def side(df: DataFrame, name: str, *more: str) -> DataFrame:
        return df.select(
            F.col("station_key").alias(f"{name}_station_key"),
            F.col("station_name").alias(f"{name}_station_name"),
            F.col("station_type").alias(f"{name}_station_type"),
            F.col("station_first_trip_at").alias(f"{name}_first_trip_at"),
            F.col("station_lat").alias(f"{name}_lat"),
            F.col("station_lon").alias(f"{name}_lon"),
            *[F.col(c).alias(f"{name}_{c}") for c in more],
        )

    joined = (
        side(old_entities, "old")
        .join(links, "old_station_key")
        .join(side(new_entities, "new", "in_city"), "new_station_key")
    )
    fate = disposition(
        F.col("new_lat"),
        F.col("new_station_type"),
        F.coalesce("new_in_city", F.lit(True)),
        F.col("old_station_key"),
        F.col("new_station_key"),
    )
    return joined.withColumn("disposition", fate).orderBy("old_station_key", "new_station_key")


def accounting(old_obs: DataFrame, new_obs: DataFrame) -> DataFrame:
    """One row: is every old observation found once, with the same endpoints?"""
    before = old_obs.agg(
        F.count(F.lit(1)).alias("old_observation_rows"),
        F.sum("valid_endpoint_count").alias("old_endpoints"),
    )
    after = match_observations(old_obs, new_obs).agg(
        F.count(F.lit(1)).alias("joined_rows"),
        F.sum("old_valid").alias("joined_endpoints"),
        F.count_if(F.col("old_valid") != F.col("new_valid")).alias("changed_counts"),
    )
    return before.crossJoin(after)  # one row each


def date_risks(public: DataFrame, entities: DataFrame) -> DataFrame:
    """Public entities with an earlier unlocated one of the same name.

    Only the earliest unlocated date per name can be the minimum, so the join
    is one row per name instead of all pairs of a name.
    """
    unlocated = (
        entities.filter("station_lat IS NULL")
        .groupBy("station_name")
        .agg(F.min("station_first_trip_at").alias("earlier_unlocated_same_name"))
    )
    columns = ["station_key", "station_name", "station_type", "station_first_trip_at"]
    columns += [c for c in ("current_feed_match_status",) if c in public.columns]
    return (
        public.select(*columns)
        .join(unlocated, "station_name")
        .filter("earlier_unlocated_same_name < station_first_trip_at")
    )


def coarse_accounting(obs: DataFrame) -> DataFrame:
    return obs.agg(
        F.sum("coarse_coordinate_count").alias("coarse_named_endpoints"),
        F.count_if(F.col("coarse_coordinate_count") > 0).alias("affected_observation_groups"),
    )


def cutoff_crossing(public: DataFrame, year: int, risks: DataFrame | None = None) -> DataFrame:
    """One row: dates from ``year`` on whose name has a history before it."""
    recent = F.year("station_first_trip_at") >= year
    earlier = F.col("earlier_same_name_trip_at")
    counts = public.agg(
        F.count_if(earlier.isNotNull()).alias("earlier_same_name_history_rows"),
        F.count_if(recent & (F.year(earlier) < year)).alias("earlier_same_name_history_crosses"),
        F.count_if(F.coalesce("service_date_review_reasons", F.lit("")) != "").alias(
            "service_date_review_rows"
        ),
    )
    if risks is None:
        return counts
    crossing = recent & (F.year("earlier_unlocated_same_name") < year)
    return counts.crossJoin(
        risks.agg(
            F.count(F.lit(1)).alias("earlier_unlocated_same_name_count"),
            F.count_if(crossing).alias("earlier_unlocated_same_name_crosses"),
        )
    )


def service_date_review(public: DataFrame, risks: DataFrame) -> DataFrame:
    """Rows with review reasons, with the earliest unlocated date of their name."""
    return (
        public.filter("coalesce(service_date_review_reasons, '') <> ''")
        .join(risks.select("station_key", "earlier_unlocated_same_name"), "station_key", "left")
        .select(
            "station_key",
            "station_name",
            "station_type",
            "station_first_trip_at",
            "earlier_same_name_trip_at",
            "earlier_unlocated_same_name",
            "current_feed_match_status",
            "service_date_review_reasons",
            "first_trip_archive",
            "first_trip_id",
        )
    )


def build_counts(entities: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Rows, types and weak evidence of one build, for a before/after table."""
    return entities.groupBy("station_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("endpoint_count") < rules.min_evidence).alias("low_evidence_rows"),
        F.count_if(is_coarse(F.col("station_lat"), F.col("station_lon"), rules)).alias("coarse_grid_rows"),
    )


def audit_checks(old_entities: DataFrame, old_obs: DataFrame, new_obs: DataFrame, traced: DataFrame) -> DataFrame:
    """(check_name, violations) of the before/after accounting."""

    def row(name: str, violations: Column) -> Column:
        return F.struct(F.lit(name).alias("check_name"), violations.alias("violations"))

    sums = accounting(old_obs, new_obs)
    rows = sums.select(
        F.inline(
            F.array(
                row(
                    "every_old_observation_joined_once",
                    F.abs(F.col("old_observation_rows") - F.col("joined_rows")),
                ),
                row(
                    "every_old_valid_endpoint_preserved",
                    F.abs(F.col("old_endpoints") - F.col("joined_endpoints")),
                ),
                row("no_observation_endpoint_counts_changed", F.col("changed_counts")),
            )
        )
    )
    lost = old_entities.join(
        traced.select(F.col("old_station_key").alias("station_key")), "station_key", "left_anti"
    ).agg(F.count(F.lit(1)).alias("violations"))
    return rows.unionByName(
        lost.select(F.lit("every_old_entity_traced").alias("check_name"), "violations")
    )
