"""Published metrics and named checks; a check counts its violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetrace.operators.entities import first_trip
from placetrace.operators.joins import require_none
from placetrace.operators.observe import endpoints
from placetrace.operators.profile import month_gaps, rows_by_month
from placetrace.params import DEFAULT, INVENTORY_COLUMNS, Rules


def count_as_check(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("check_name"), "violations"
    )


def all_checks(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def require_all(checks: DataFrame) -> None:
    """Raise with the names of the failed checks.  One row per check comes here."""
    failed = [row.check_name for row in checks.filter("violations <> 0").collect()]
    if failed:
        raise ValueError(f"validation failed: {sorted(failed)}")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphan_observations(obs: DataFrame, entities: DataFrame) -> DataFrame:
    return obs.join(entities.select("station_key"), "station_key", "left_anti")


def orphan_merges(merges: DataFrame, entities: DataFrame) -> DataFrame:
    keys = entities.select(F.col("station_key").alias("merged_station_key"))
    return merges.join(keys, "merged_station_key", "left_anti")


def first_date_mismatches(entities: DataFrame, reproduced: DataFrame) -> DataFrame:
    """Full outer comparison of first dates; missing on one side is a mismatch."""
    mine = entities.select("station_key", F.col("station_first_trip_at").alias("stated"))
    other = reproduced.select("station_key", F.col("station_first_trip_at").alias("derived"))
    return mine.join(other, "station_key", "full_outer").filter(
        ~F.col("stated").eqNullSafe(F.col("derived"))
    )


def endpoint_reconciliation(trips: DataFrame, kept: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: resolved and excluded endpoints against two per trip."""
    return (
        kept.agg(F.coalesce(F.sum("endpoint_count"), F.lit(0)).alias("resolved_endpoints"))
        .crossJoin(excluded.agg(F.coalesce(F.sum("endpoint_count"), F.lit(0)).alias("excluded_endpoints")))
        .crossJoin(trips.agg(F.count(F.lit(1)).alias("trip_rows")))
        .withColumn(
            "unaccounted",
            2 * F.col("trip_rows") - F.col("resolved_endpoints") - F.col("excluded_endpoints"),
        )
    )


def public_metrics(public: DataFrame) -> DataFrame:
    return public.agg(
        F.count(F.lit(1)).alias("public_rows"),
        F.countDistinct("station_key").alias("unique_keys"),
        F.countDistinct("station_id").alias("unique_current_source_ids"),
        F.count_if(F.col("station_type") == "public_rack").alias("public_racks"),
        F.count_if(F.col("endpoint_count") < 10).alias("low_evidence_rows"),
        F.count_if(F.col("reported_online_at").isNotNull()).alias("with_online_dates"),
        F.count_if(F.col("quality_flags").contains("conflicting_reported_online_dates")).alias(
            "conflicting_online_dates"
        ),
        F.count_if(F.col("station_first_arrival_at") < F.col("station_first_departure_at")).alias(
            "arrival_precedes_departure"
        ),
        F.min("station_first_trip_at").alias("earliest_station_trip"),
        F.max("station_last_trip_at").alias("latest_station_trip"),
    )


def frequencies(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def build_summary(
    entities: DataFrame,
    obs: DataFrame,
    excluded: DataFrame,
    trips: DataFrame,
    merges: DataFrame | None = None,
    review: DataFrame | None = None,
    rules: Rules = DEFAULT,
) -> DataFrame:
    """One row with the size of every part of a build."""
    inside = F.col("in_city")
    operational = F.col("station_type") == "operational"

    def size(df: DataFrame | None, name: str) -> DataFrame:
        if df is None:
            return entities.sparkSession.range(1).select(F.lit(0).cast("long").alias(name))
        return df.agg(F.count(F.lit(1)).alias(name))

    parts = [
        trips.agg(F.countDistinct("archive").alias("archive_count"), F.count(F.lit(1)).alias("trip_rows")),
        entities.agg(
            F.count(F.lit(1)).alias("all_entities"),
            F.count_if(F.coalesce(inside, F.lit(False)) & ~operational).alias("public_entities"),
            F.count_if(operational).alias("operational_entities"),
            F.count_if(~inside).alias("outside_entities"),
            F.count_if(inside.isNull()).alias("unlocated_entities"),
        ),
        excluded.agg(F.coalesce(F.sum("endpoint_count"), F.lit(0)).alias("excluded_endpoints")),
        obs.agg(
            F.sum("endpoint_count").alias("resolved_endpoints"),
            F.sum("valid_endpoint_count").alias("valid_resolved_endpoints"),
        ),
        size(merges, "accepted_alias_merges"),
        size(review, "identity_review_pairs"),
    ]
    # Every part is a single row.
    return reduce(lambda a, b: a.crossJoin(b), parts)


def feed_checks(feeds_raw: DataFrame, name: str, id_column: str, lat: str, lon: str, page_size: int) -> DataFrame:
    """Violations that make a feed snapshot unusable: empty, cut off, repeated, misplaced.

    ``page_size`` is the size asked for in the request: a response that fills it may be cut off.
    """
    y, x = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    good = F.coalesce(y.between(-90, 90) & x.between(-180, 180), F.lit(False))
    sums = feeds_raw.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~good).alias("bad"), F.countDistinct(id_column).alias("ids")
    )

    def row(label: str, value: Column):
        return F.struct(
            F.lit(f"{name}_{label}").alias("check_name"), value.cast("long").alias("violations")
        )

    return sums.select(
        F.inline(
            F.array(
                row("not_empty", (F.col("rows") == 0).cast("int")),
                row("not_truncated", (F.col("rows") >= page_size).cast("int")),
                row("unique_ids", F.col("rows") - F.col("ids")),
                row("coordinates_in_range", F.col("bad")),
            )
        )
    )


def id_set_differences(information: DataFrame, status: DataFrame) -> DataFrame:
    """(check_name, violations): ids of one operator feed that the other lacks."""
    info, stat = information.select("station_id"), status.select("station_id")
    return all_checks(
        [
            count_as_check(info.join(stat, "station_id", "left_anti"), "information_without_status"),
            count_as_check(stat.join(info, "station_id", "left_anti"), "status_without_information"),
            count_as_check(repeated(stat, "station_id"), "repeated_status_ids"),
        ]
    )


def build_checks(
    entities: DataFrame,
    public: DataFrame,
    obs: DataFrame,
    excluded: DataFrame,
    trips: DataFrame,
    merges: DataFrame,
) -> DataFrame:
    unaccounted = endpoint_reconciliation(trips, obs, excluded).select(
        F.lit("all_trip_rows_accounted_for").alias("check_name"),
        F.abs("unaccounted").alias("violations"),
    )
    inside = F.coalesce(F.col("in_city"), F.lit(False))
    text_id = public.schema["station_id"].dataType.typeName() == "string"
    derived = obs.groupBy("station_key").agg(F.min("first_at").alias("station_first_trip_at"))
    return all_checks(
        [
            unaccounted,
            count_as_check(repeated(entities, "station_key"), "station_keys_unique"),
            count_as_check(
                public.filter(
                    "station_lat IS NULL OR station_lon IS NULL OR station_first_trip_at IS NULL"
                ),
                "coordinates_and_dates_present_in_public_output",
            ),
            count_as_check(
                first_date_mismatches(entities, derived),
                "every_first_date_matches_observation_minimum",
            ),
            count_as_check(orphan_observations(obs, entities), "observation_mapping_has_no_orphans"),
            count_as_check(orphan_merges(merges, entities), "accepted_merge_keys_exist"),
            count_as_check(
                public.filter(~inside | (F.col("station_type") == "operational")),
                "public_output_contains_only_public_city_locations",
            ),
            count_as_check(
                public.sparkSession.range(0 if text_id else 1), "source_ids_are_text"
            ),
            count_as_check(
                first_date_mismatches(public, first_trip(public, obs)),
                "query_reproduces_reference_dates",
            ),
            count_as_check(month_gaps(rows_by_month(trips)), "every_month_in_observed_coverage_present"),
        ]
    )


def reconciliation_checks(
    entities: DataFrame, feeds: DataFrame, candidates: DataFrame, covered: DataFrame
) -> DataFrame:
    accepted = candidates.filter("accepted")
    missing = feeds.select("source", "feed_station_id").join(
        covered, ["source", "feed_station_id"], "left_anti"
    )
    return all_checks(
        [
            count_as_check(
                repeated(accepted, "source", "feed_station_id").unionByName(
                    repeated(accepted, "source", "station_key"), allowMissingColumns=True
                ),
                "accepted_feed_matches_one_to_one",
            ),
            count_as_check(
                missing.unionByName(
                    repeated(covered, "source", "feed_station_id").drop("n")
                ),
                "every_feed_row_accounted_for",
            ),
            count_as_check(accepted.filter("rank >= 99"), "no_fuzzy_only_matches_accepted"),
            count_as_check(
                entities.filter("opening_date_status <> 'unverified_first_trip_proxy'"),
                "all_opening_dates_explicitly_unverified",
            ),
        ]
    )


def changed_cells(inventory: DataFrame, city: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Inventory rows of which a cell differs from the field of the city row that it comes from.

    ``names`` maps fields to headers.  A field that no row of the feed has must be NULL; nested fields are compared as
    the JSON text that stands in their cell.
    """
    names = dict(names) if names else {c: c for c in city.columns}
    nested = {f.name for f in city.schema if f.dataType.typeName() in ("struct", "array", "map")}

    def raw(field: str) -> Column:
        if field not in city.columns:
            return F.lit(None).cast("string")
        return F.to_json(F.col(f"`{field}`")) if field in nested else F.col(f"`{field}`")

    fields = list(names)
    cells = [F.col(f"`{names[f]}`").alias(f"__m{i}") for i, f in enumerate(fields)]
    theirs = city.select(F.col("id").alias("__id"), *[raw(f).alias(f"__r{i}") for i, f in enumerate(fields)])
    mine = inventory.select(F.col(f"`{names['id']}`").alias("__key"), *cells)
    same = [F.col(f"__m{i}").eqNullSafe(F.col(f"__r{i}")) for i in range(len(fields))]
    joined = mine.join(theirs, F.col("__key") == F.col("__id"), "left")
    return joined.filter(~reduce(lambda a, b: a & b, same)).select("__key")


def inventory_checks(
    inventory: DataFrame,
    city: DataFrame,
    public: DataFrame,
    id_header: str = "id",
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    ids = city.select(F.col("id").alias(id_header))
    lost = ids.join(inventory.select(id_header), id_header, "left_anti")
    linked = public.select("city_station_id", *[F.col(c).alias(f"__{c}") for c in INVENTORY_COLUMNS])
    joined = inventory.join(linked, F.col(id_header) == F.col("city_station_id"), "left")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in INVENTORY_COLUMNS])
    wrong = joined.filter(~same | (F.col("reference_matched") != F.col("city_station_id").isNotNull()))
    return all_checks(
        [
            count_as_check(
                lost.unionByName(repeated(inventory, id_header).drop("n")),
                "inventory_preserves_city_rows",
            ),
            count_as_check(changed_cells(inventory, city, names), "inventory_preserves_city_cells"),
            count_as_check(wrong, "inventory_joins_published_reference_exactly"),
        ]
    )


def sample_entities(
    public: DataFrame, names: Sequence[str] = (), cutoff: str = "2023-01-01"
) -> DataFrame:
    """A few entities worth checking by hand: earliest, latest, arrivals, by name.

    Each part is a top-k, so only k rows per task move.
    """
    early = [F.asc_nulls_last("station_first_trip_at"), F.asc("station_key")]
    late = [F.desc_nulls_last("station_first_trip_at"), F.asc("station_key")]
    parts = [
        public.orderBy(*early).limit(2),
        public.orderBy(*late).limit(2),
        public.filter("first_trip_role = 'end'").orderBy(*early).limit(1),
        public.filter(F.col("station_name").isin(list(names))),
    ]
    if "earlier_same_name_trip_at" in public.columns:
        at = F.lit(cutoff).cast("timestamp_ntz")
        crossing = (F.col("station_first_trip_at") >= at) & (F.col("earlier_same_name_trip_at") < at)
        parts.append(public.filter(crossing).orderBy(*early).limit(1))
    return reduce(lambda a, b: a.unionByName(b), parts).dropDuplicates(["station_key"])


def spot_check(samples: DataFrame, trips: DataFrame) -> DataFrame:
    """Re-find the first event of each sample in the trips, with the raw row as evidence.

    ``verified`` needs a trip end of that file, trip id and role at the stated
    time; its id, name and point are the evidence.  The samples are few, so Spark
    ships them to the scan when their size allows.
    """
    ends = endpoints(trips).select(
        F.col("archive").alias("first_trip_archive"),
        F.col("member").alias("first_trip_member"),
        F.col("trip_id").alias("first_trip_id"),
        F.col("role").alias("first_trip_role"),
        "event_at",
        F.struct("station_id", "station_name", "lat", "lon").alias("raw"),
    )
    keys = ["first_trip_archive", "first_trip_member", "first_trip_id", "first_trip_role"]
    wanted = samples.select("station_key", "station_name", "station_first_trip_at", "station_lat", "station_lon", *keys)
    at_time = F.col("event_at") == F.col("station_first_trip_at")
    found = ends.join(wanted, keys).groupBy("station_key").agg(
        F.count(F.lit(1)).alias("rows_found"),
        F.count_if(at_time).alias("rows_at_time"),
        F.min(F.when(at_time, F.col("raw"))).alias("raw"),
    )
    return (
        wanted.join(found, "station_key", "left")
        .withColumn("rows_found", F.coalesce("rows_found", F.lit(0)))
        .withColumn("verified", F.coalesce(F.col("rows_at_time") > 0, F.lit(False)))
        .withColumns({f"source_{name}": F.col(f"raw.{name}") for name in ("station_id", "station_name", "lat", "lon")})
        .drop("rows_at_time", "raw")
    )


def require_evidence(spots: DataFrame) -> None:
    """Raise when a sampled first event is not in the trips."""
    missing = spots.filter("NOT verified").select("station_key", "first_trip_archive", "first_trip_member", "first_trip_id")
    require_none(missing, "no source evidence for first trips")
