"""Quality profile of trips, per file or over everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.functions.geo import in_box
from placetrace.functions.times import month_text
from placetrace.operators.joins import join_null_safe
from placetrace.operators.observe import census
from placetrace.params import DEFAULT, Rules
from placetrace.session import checkpoint

FILE = ("archive", "member")

# Measures of the profile that add up over files.
ADDITIVE = (
    "rows",
    "missing_start_id",
    "missing_end_id",
    "missing_start_name",
    "missing_end_name",
    "missing_start_coordinates",
    "missing_end_coordinates",
    "invalid_start_coordinates",
    "invalid_end_coordinates",
    "invalid_start_time",
    "invalid_end_time",
    "reversed_trips",
    "zero_duration_trips",
    "duplicate_or_missing_trip_ids",
)


def profile_trips(
    trips: DataFrame, by: Sequence[str] = FILE, rules: Rules = DEFAULT, ends: DataFrame | None = None
) -> DataFrame:
    """Twenty-one measures per group.

    All but the distinct trip ids come from the census of trip ends (``ends``,
    made here unless given); trips themselves are read for their ids only.
    Distinct values are grouped by (file, value) first: that combines on the map
    side and keeps a huge file from being counted in one task.
    """
    by = list(by)
    if ends is None:
        ends = checkpoint(census(trips, by))
    lat, lon, role, state = F.col("lat"), F.col("lon"), F.col("role"), F.col("state")
    located = lat.isNotNull() & lon.isNotNull()
    start = role == "start"

    def total(condition, value="n"):
        return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0).cast("long"))

    measures = [
        total(start).alias("rows"),
        (total(start) - total(start, "named")).alias("missing_trip_ids"),
        total(start & (state == "reversed")).alias("reversed_trips"),
        total(start & (state == "zero")).alias("zero_duration_trips"),
    ]
    for end in ("start", "end"):
        here = role == end
        measures += [
            F.min(F.when(here, F.col("first_at"))).alias(f"earliest_{end}"),
            F.max(F.when(here, F.col("last_at"))).alias(f"latest_{end}"),
            (total(here) - total(here, "timed")).alias(f"invalid_{end}_time"),
            total(here & F.col("station_id").isNull()).alias(f"missing_{end}_id"),
            total(here & F.col("station_name").isNull()).alias(f"missing_{end}_name"),
            total(here & ~located).alias(f"missing_{end}_coordinates"),
            total(here & located & ~in_box(lat, lon, rules.box)).alias(f"invalid_{end}_coordinates"),
        ]
    plain = ends.groupBy(*by).agg(*measures)
    ids = ends.filter("station_id IS NOT NULL").groupBy(*by, "role", "station_id").agg(F.count(F.lit(1)).alias("points"))
    ids = ids.groupBy(*by).agg(*[F.count_if(role == end).alias(f"distinct_{end}_ids") for end in ("start", "end")])
    named = trips.groupBy(*by, "trip_id").agg(F.count(F.lit(1)).alias("uses"))
    named = named.groupBy(*by).agg(F.count("trip_id").alias("distinct_trip_ids"))
    out = plain
    for counts in (ids, named):
        out = join_null_safe(out, counts, by, nullable=frozenset(by)) if by else out.crossJoin(counts)
    none = F.lit(0).cast("long")
    distinct = [F.coalesce(f"distinct_{end}_ids", none).alias(f"distinct_{end}_ids") for end in ("start", "end")]
    repeated = (F.col("rows") - F.col("distinct_trip_ids")).alias("duplicate_or_missing_trip_ids")
    return out.select(*[c for c in plain.columns], *distinct, repeated)


def profile_totals(profiles: DataFrame) -> DataFrame:
    """Sums of the additive measures over per-file profiles."""
    return profiles.agg(*[F.sum(name).alias(name) for name in ADDITIVE])


def rows_by_month(trips: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    month = month_text(F.col("started_at")).alias("month")
    return trips.groupBy(*by, month).agg(F.count(F.lit(1)).alias("rows"))


def rows_by_year(months: DataFrame) -> DataFrame:
    year = F.substring("month", 1, 4).alias("year")
    return months.groupBy(year).agg(F.sum("rows").alias("rows"))


def month_gaps(months: DataFrame) -> DataFrame:
    """Months between the first and the last one that have no rows."""
    first_day = F.to_date(F.concat("month", F.lit("-01")))
    span = months.agg(F.min(first_day).alias("low"), F.max(first_day).alias("high"))
    calendar = span.select(
        F.explode(F.sequence("low", "high", F.expr("interval 1 month"))).alias("day")
    ).select(month_text(F.col("day")).alias("month"))
    return calendar.join(months.filter("rows > 0"), "month", "left_anti")


def header_signatures(members: DataFrame) -> DataFrame:
    """How many different header rows the trip files have."""
    trips = members.filter("kind <> 'station_lookup' AND duplicate_of IS NULL")
    return trips.agg(F.countDistinct("headers").alias("header_signatures"))
