"""Decision rules: statuses, match methods, flags and reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placetrace.functions.text import join_list, sorted_list
from placetrace.params import DEFAULT, Rules

# Quality flags that make a first date worth a review, in order.
REVIEW_FLAGS = (
    "name_has_multiple_locations",
    "possible_rename",
    "fewer_than_10_endpoints",
    "location_inferred_from_current_feed",
    "first_archive_day",
)


def operator_status(installed: Column, renting: Column, returning: Column) -> Column:
    return (
        F.when(installed == 0, "not_installed")
        .when((renting == 1) & (returning == 1), "renting_and_returning")
        .otherwise("service_restricted")
    )


def match_rank(
    exact_name: Column, shared_id: Column, same_class: Column, metres: Column, rules: Rules = DEFAULT
) -> Column:
    """0 name and id, 1 name, 2 id; 99 is for review only."""
    named = exact_name & (metres <= rules.match_metres)
    return (
        F.when(~same_class | metres.isNull(), 99)
        .when(named & shared_id, 0)
        .when(named, 1)
        .when(shared_id & (metres <= rules.alias_metres), 2)
        .otherwise(99)
    )


def match_method(rank: Column) -> Column:
    return (
        F.when(rank == 0, "name_and_short_name_within_150m")
        .when(rank == 1, "name_within_150m")
        .when(rank == 2, "short_name_within_35m")
        .otherwise("review_only")
    )


def exclusion_reason(
    valid_count: Column, first_at: Column, name_key: Column, placeholder: Column
) -> Column:
    """First reason that applies; NULL keeps the observation."""
    return (
        F.when((valid_count == 0) | first_at.isNull(), "no_valid_trip_time")
        .when(F.coalesce(name_key, F.lit("")) == "", "missing_station_name")
        .when(placeholder, "numeric_placeholder_name")
    )


def disposition(
    new_lat: Column, new_type: Column, new_in_city: Column, old_key: Column, new_key: Column
) -> Column:
    """What became of an entity of an older build."""
    return (
        F.when(new_lat.isNull(), "retained_unlocated")
        .when(new_type == "operational", "excluded_operational")
        .when(~new_in_city, "outside_city")
        .when(old_key == new_key, "same_key")
        .otherwise("reassigned_or_rekeyed")
    )


def review_reason(metres: Column, rules: Rules = DEFAULT) -> Column:
    return (
        F.when(metres.isNull(), "shared_id_location_unknown")
        .when(metres <= rules.match_metres, "possible_rename_or_rack_conversion")
        .otherwise("reused_id_or_relocation")
    )


def feed_match_status(matched: Column, has_evidence: Column) -> Column:
    return (
        F.when(matched, "matched")
        .when(F.coalesce(has_evidence, F.lit(False)), "needs_review")
        .otherwise("no_confirmed_match")
    )


def date_review_reasons(earlier_at: Column, quality_flags: Column) -> Column:
    flags = F.coalesce(quality_flags, F.lit(""))
    reasons = [F.when(earlier_at.isNotNull(), "earlier_same_name_history")]
    reasons += [F.when(flags.contains(flag), flag) for flag in REVIEW_FLAGS]
    return join_list(F.array_compact(F.array(*reasons)))


def flags_where(**conditions: Column) -> Column:
    """The names of the conditions that hold, as an array."""
    return F.array_compact(F.array(*[F.when(hit, name) for name, hit in conditions.items()]))


def tidy_flags(joined: Column) -> Column:
    """Sorted `` | `` list without blanks or repeats."""
    parts = F.transform(F.split(joined, r"\|"), lambda part: F.trim(part))
    return join_list(sorted_list(F.filter(parts, lambda part: part != "")))


def coordinate_month(source: Column, month: Column) -> Column:
    """Only a coordinate measured on trips has a month of observation."""
    borrowed = source.startswith("historical_") | source.startswith("current_feed_")
    return F.when(~borrowed, month)
