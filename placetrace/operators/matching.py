"""Current feeds against entities: candidates, one-to-one matches, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetrace.functions.geo import haversine
from placetrace.functions.rules import (
    date_review_reasons,
    feed_match_status,
    match_method,
    match_rank,
    operator_status,
)
from placetrace.functions.text import (
    levenshtein_similarity,
    name_class,
    normalize_name,
    split_list,
)
from placetrace.operators.joins import require_unique, split_join
from placetrace.operators.spatial import distance_join, point_in_boundary
from placetrace.params import DEFAULT, INVENTORY_COLUMNS, Rules

SOURCES = ("city", "gbfs")


def edit_similarity(names: Column, key: Column) -> Column:
    """Best edit-distance similarity of a name key over an array of variants."""
    return F.array_max(F.transform(names, lambda name: levenshtein_similarity(name, key)))


def feed_rows(
    city: DataFrame,
    information: DataFrame,
    status: DataFrame,
    boundary: DataFrame | None = None,
) -> DataFrame:
    """Both current inventories under one schema; fields that a feed may leave out are blank or NULL."""

    def field(df: DataFrame, name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    city_rows = city.select(
        F.lit("city").alias("source"),
        F.col("id").alias("feed_station_id"),
        F.coalesce(field(city, "short_name"), F.lit("")).alias("short_name"),
        "station_name",
        F.col("latitude").cast("double").alias("lat"),
        F.col("longitude").cast("double").alias("lon"),
        field(city, "status").alias("status"),
        F.lit("").alias("feed_station_type"),
        field(city, "total_docks").cast("int").alias("capacity"),
    )
    operator_rows = information.join(
        status.select("station_id", "is_installed", "is_renting", "is_returning"), "station_id", "left"
    ).select(
        F.lit("gbfs").alias("source"),
        F.col("station_id").alias("feed_station_id"),
        F.coalesce("short_name", F.lit("")).alias("short_name"),
        F.col("name").alias("station_name"),
        F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"),
        operator_status(F.col("is_installed"), F.col("is_renting"), F.col("is_returning")).alias("status"),
        F.coalesce("station_type", F.lit("")).alias("feed_station_type"),
        F.col("capacity").cast("int").alias("capacity"),
    )
    rows = city_rows.unionByName(operator_rows)
    if boundary is not None:
        rows = point_in_boundary(rows, boundary)
    else:
        rows = rows.withColumn("in_city", F.lit(None).cast("boolean"))
    key = normalize_name(F.col("station_name"))
    return rows.select(
        "source",
        "feed_station_id",
        "short_name",
        "station_name",
        F.col("lat").alias("station_lat"),
        F.col("lon").alias("station_lon"),
        "in_city",
        "status",
        "feed_station_type",
        "capacity",
        key.alias("name_key"),
        name_class(F.lower("station_name")).alias("name_class"),
    )


def match_candidates(
    entities: DataFrame,
    feeds: DataFrame,
    rules: Rules = DEFAULT,
) -> DataFrame:
    """Entity x feed evidence rows.

    Three blocked joins that exclude one another - same name; else same id;
    else near - so no pair appears twice and nothing is compared with everything.
    Only the third kind is subject to the similarity rule.
    """
    ents = entities.select(
        "station_key",
        F.col("station_name").alias("reference_name"),
        F.col("station_first_trip_at").alias("reference_first_trip_at"),
        F.col("station_last_trip_at").alias("reference_last_trip_at"),
        F.col("endpoint_count").alias("reference_endpoint_count"),
        "station_type",
        F.col("station_lat").alias("lat"),
        F.col("station_lon").alias("lon"),
        F.array_distinct(
            F.transform(F.split("name_variants", r" \| "), normalize_name)
        ).alias("names"),
        split_list(F.col("source_ids")).alias("ids"),
    )
    rows = feeds.select(
        "source",
        "feed_station_id",
        F.col("station_name").alias("feed_name"),
        F.col("short_name").alias("feed_short_name"),
        F.col("name_key").alias("feed_key"),
        F.col("name_class").alias("feed_class"),
        F.col("station_lat").alias("lat"),
        F.col("station_lon").alias("lon"),
    )
    feed = rows.withColumnsRenamed({"lat": "feed_lat", "lon": "feed_lon"})
    exact = F.array_contains("names", F.col("feed_key"))
    shared = (F.col("feed_short_name") != "") & F.array_contains("ids", F.col("feed_short_name"))
    by_name = split_join(
        ents.withColumn("key", F.explode("names")),
        feed.withColumn("key", F.col("feed_key")),
        ["key"],
        ["station_key"],
        shuffled=True,
    ).drop("key")
    by_id = split_join(
        ents.withColumn("key", F.explode("ids")),
        feed.filter("feed_short_name <> ''").withColumn("key", F.col("feed_short_name")),
        ["key"],
        ["station_key"],
        condition=~exact,
        shuffled=True,
    ).drop("key")
    # Entities are the ones that are copied to the cells around them: they are the fewer.
    near = distance_join(rows, ents, rules.match_metres, "feed_station_id", "station_key")
    near = near.select(
        *[F.col(f"b_{c}").alias(c) for c in ents.columns],
        *[F.col(f"a_{c}").alias({"lat": "feed_lat", "lon": "feed_lon"}.get(c, c)) for c in rows.columns],
    ).filter(~exact & ~shared)
    metres = F.col("metres")

    def scored(pairs: DataFrame) -> DataFrame:
        gap = haversine(F.col("lat"), F.col("lon"), F.col("feed_lat"), F.col("feed_lon"))
        return pairs.withColumn("metres", gap).withColumn("similarity", edit_similarity(F.col("names"), F.col("feed_key")))

    rank = match_rank(
        F.col("exact_name"),
        F.col("shared_short_name"),
        F.col("station_type") == F.col("feed_class"),
        metres,
        rules,
    )
    named = scored(by_name.unionByName(by_id)).withColumn("exact_name", exact).withColumn("shared_short_name", shared)
    named = named.filter(F.col("exact_name") | F.col("shared_short_name")).withColumn("rank", rank)
    # Pairs that are only near are for review, so who wants ranks below 99 need not form them.
    close = scored(near).filter((F.col("similarity") >= rules.min_similarity) | (metres <= rules.alias_metres))
    no = F.lit(False)
    close = close.withColumns({"exact_name": no, "shared_short_name": no, "rank": F.lit(99)})
    kept = named.unionByName(close)
    return kept.select(
        "station_key",
        "reference_name",
        "reference_first_trip_at",
        "reference_last_trip_at",
        "reference_endpoint_count",
        "source",
        "feed_station_id",
        "feed_name",
        "feed_short_name",
        F.round(metres, 1).alias("distance_meters"),
        F.round("similarity", 4).alias("name_similarity"),
        "exact_name",
        "shared_short_name",
        (F.col("station_type") == F.col("feed_class")).alias("same_name_class"),
        match_method(F.col("rank")).alias("match_method"),
        "rank",
    )


def with_evidence(candidates: DataFrame) -> DataFrame:
    """Candidates that share a name or an id.

    Only these are accepted or call for a review of a match.  Pairs that are only near
    grow with the square of the places that pile up on a site; asked for on the
    result of ``match_candidates``, this leaves their join out of the plan.
    """
    return candidates.filter("rank < 99 OR exact_name OR shared_short_name")


def resolve_matches(candidates: DataFrame) -> DataFrame:
    """Marks as ``accepted`` the unique best candidate both ways.

    An entity proposes to a feed row when its best rank occurs once; a feed row
    accepts when exactly one entity proposes.  Aggregates, not windows, so the
    candidates of a busy entity are combined before they move.
    """
    eligible = (
        candidates.filter("rank < 99")
        .groupBy("source", "station_key", "rank")
        .agg(F.count(F.lit(1)).alias("ties"), F.min("feed_station_id").alias("feed_station_id"))
    )
    proposals = (
        eligible.groupBy("source", "station_key")
        .agg(F.min(F.struct("rank", "ties", "feed_station_id")).alias("best"))
        .filter("best.ties = 1")
        .select("source", "station_key", "best.feed_station_id")
    )
    accepted = (
        proposals.groupBy("source", "feed_station_id")
        .agg(F.count(F.lit(1)).alias("claims"), F.min("station_key").alias("station_key"))
        .filter("claims = 1")
        .select("source", "feed_station_id", "station_key", F.lit(True).alias("accepted"))
    )
    return candidates.join(accepted, ["source", "feed_station_id", "station_key"], "left").withColumn(
        "accepted", F.coalesce("accepted", F.lit(False))
    )


def coverage(feeds: DataFrame, candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Every feed row with the entity that was matched to it, if any."""
    accepted = candidates.filter("accepted").select(
        "source", "feed_station_id", "station_key", "match_method"
    )
    history = entities.select(
        "station_key",
        F.col("station_type").alias("reference_station_type"),
        "station_first_trip_at",
    )
    return (
        feeds.drop("name_key", "name_class")
        .join(accepted, ["source", "feed_station_id"], "left")
        .join(history, "station_key", "left")
        .withColumn(
            "coverage_status",
            F.when(F.col("match_method").isNotNull(), "matched").otherwise(
                "no_unambiguous_history_match"
            ),
        )
    )


def coverage_counts(covered: DataFrame) -> DataFrame:
    inside, matched = F.col("in_city"), F.col("station_key").isNotNull()
    return covered.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(inside).alias("inside_city"),
        F.count_if(matched).alias("matched"),
        F.count_if(inside & matched).alias("inside_city_matched"),
    )


def earlier_same_name(entities: DataFrame) -> DataFrame:
    """Entities whose names occur earlier elsewhere, with the earliest time."""
    names = entities.select(
        "station_key",
        "station_first_trip_at",
        F.explode(
            F.array_distinct(F.transform(F.split("name_variants", r" \| "), normalize_name))
        ).alias("name"),
    )
    first = names.groupBy("name").agg(F.min("station_first_trip_at").alias("earliest"))
    return (
        names.join(first, "name")
        .groupBy("station_key")
        .agg(
            F.min("earliest").alias("earlier_same_name_trip_at"),
            F.min("station_first_trip_at").alias("own"),
        )
        .filter("earlier_same_name_trip_at < own")
        .drop("own")
    )


def reconcile(
    entities: DataFrame, feeds: DataFrame, candidates: DataFrame, snapshot_date: str | None = None
) -> DataFrame:
    """Entities with their matched feed rows, match status and date review."""
    accepted = candidates.filter("accepted")
    out = entities
    for source in SOURCES:
        rows = feeds.filter(F.col("source") == source).select(
            "feed_station_id", "station_name", "status", "feed_station_type"
        )
        match = accepted.filter(F.col("source") == source).select(
            "station_key", "feed_station_id", "match_method", "distance_meters"
        )
        columns = [
            F.col("feed_station_id").alias(f"{source}_station_id"),
            F.col("station_name").alias(f"{source}_station_name"),
            F.col("status").alias(f"{source}_status"),
            F.col("match_method").alias(f"{source}_match_method"),
            F.col("distance_meters").alias(f"{source}_match_distance_meters"),
        ]
        if source == "gbfs":
            columns.append(F.col("feed_station_type").alias("gbfs_station_type"))
        linked = match.join(rows, "feed_station_id").select("station_key", *columns)
        out = out.join(linked, "station_key", "left")
    evidence = with_evidence(candidates).select("station_key", F.lit(True).alias("has_evidence")).distinct()
    out = out.join(evidence, "station_key", "left").join(
        earlier_same_name(entities), "station_key", "left"
    )
    matched = F.col("city_station_id").isNotNull() | F.col("gbfs_station_id").isNotNull()
    return (
        out.withColumn("current_feed_match_status", feed_match_status(matched, F.col("has_evidence")))
        .withColumn("opening_date_status", F.lit("unverified_first_trip_proxy"))
        .withColumn(
            "service_date_review_reasons",
            date_review_reasons(F.col("earlier_same_name_trip_at"), F.col("quality_flags")),
        )
        .withColumn("feed_snapshot_date", F.lit(snapshot_date).cast("string"))
        .drop("has_evidence")
    )


def inventory_names(declared: list[dict], observed: list[str], aliases: dict[str, str]) -> dict[str, str]:
    """Source field -> header: declared fields at a position, then any others seen."""
    fields = [c["fieldName"] for c in declared if c.get("position", 0) >= 0] + list(observed)
    return {field: aliases.get(field, field) for field in fields}


def enrich_inventory(
    city: DataFrame, reference: DataFrame, names: dict[str, str] | None = None
) -> DataFrame:
    """Every inventory row with the reference row linked to its id.

    Raises when headers collide or when an id is not unique on either side,
    because the join would then change the grain.
    """
    names = names or {c: c for c in city.columns}
    headers = list(names.values())
    added = ["reference_matched", *INVENTORY_COLUMNS]
    if set(headers) & set(added):
        raise ValueError(f"inventory columns collide with {sorted(set(headers) & set(added))}")
    if len(set(headers)) != len(headers):
        raise ValueError("two inventory fields share a header")
    absent = {f: F.lit(None).cast("string") for f in names if f not in city.columns}
    rows = city.withColumns(absent) if absent else city
    nested = {f.name for f in rows.schema if f.dataType.typeName() in ("struct", "array", "map")}
    cells = [
        (F.to_json(F.col(f"`{f}`")) if f in nested else F.col(f"`{f}`")).alias(header)
        for f, header in names.items()
    ]
    rows = rows.select(*cells)
    linked = reference.filter("coalesce(city_station_id, '') <> ''").select(
        F.col("city_station_id").alias("__id"), *INVENTORY_COLUMNS
    )
    key = names["id"]
    require_unique(rows, [f"`{key}`"], "an inventory id occurs twice")
    require_unique(linked, ["__id"], "several reference rows claim one inventory id")
    return (
        rows.join(linked, F.col(f"`{key}`") == F.col("__id"), "left")
        .withColumn("reference_matched", F.col("__id").isNotNull())
        .select(*[F.col(f"`{h}`") for h in headers], *added)
    )


def populated_columns(df: DataFrame) -> DataFrame:
    """(column_name, populated_rows): cells that are neither NULL nor ''.

    One aggregate over the table, turned into rows afterwards.
    """
    counts = df.agg(
        *[
            F.count_if(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != "")).alias(f"n{i}")
            for i, c in enumerate(df.columns)
        ]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("populated_rows"))
            for i, c in enumerate(df.columns)
        ]
    )
    return counts.select(F.inline(pairs))
