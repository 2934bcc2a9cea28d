"""Aliases: entities that share an id at one place, merged; and pairs to review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.functions.geo import haversine
from placetrace.functions.rules import review_reason
from placetrace.operators.joins import pairs_within
from placetrace.operators.spatial import distance_join
from placetrace.params import DEFAULT, Rules
from placetrace.session import checkpoint


def entity_ids(clustered: DataFrame) -> DataFrame:
    """The sorted source ids of each entity."""
    return (
        clustered.filter("station_id IS NOT NULL")
        .groupBy("station_key")
        .agg(F.array_sort(F.collect_set("station_id")).alias("ids"))
    )


def _placed(entities: DataFrame, clustered: DataFrame) -> DataFrame:
    """Located entities with their (name key, cluster) order and their ids."""
    order = clustered.groupBy("station_key").agg(
        F.min(F.struct("name_key", "cluster_no")).alias("idx")
    )
    rows = (
        entities.filter("station_lat IS NOT NULL")
        .select(
            "station_key",
            "station_name",
            "station_type",
            "station_first_trip_at",
            F.col("station_lat").alias("lat"),
            F.col("station_lon").alias("lon"),
        )
        .join(order, "station_key")
        .join(entity_ids(clustered), "station_key", "left")
    )
    return checkpoint(rows)


def _shared_id_pairs(rows: DataFrame, rules: Rules) -> DataFrame:
    """Pairs within alias distance that share an id: only rows of one id, class and cell meet."""
    by_id = rows.withColumn("source_id", F.explode("ids"))
    pairs = distance_join(
        by_id, by_id, rules.alias_metres, "station_key", "station_key", keys=["station_type", "source_id"]
    ).filter(F.col("a_idx") < F.col("b_idx"))
    first_shared = F.array_min(F.array_intersect("a_ids", "b_ids"))
    # A pair with several ids comes once for each; it counts at its first.
    return pairs.filter(F.col("a_source_id") == first_shared).withColumnRenamed("a_source_id", "source_id").drop("b_source_id")


def alias_edges(entities: DataFrame, clustered: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Pairs that share an id, a class and a place: possible renames.

    ``a`` precedes ``b`` in (name key, cluster) order; ``source_id`` is the first shared id.
    """
    return _shared_id_pairs(_placed(entities, clustered), rules)


def near_pairs(entities: DataFrame, clustered: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Pairs of one class within alias distance among the entities that have an alias edge.

    The edges come first, so entities without one - however many stand on one
    spot - are left out before any pair by distance is formed.
    """
    rows = _placed(entities, clustered)
    edges = checkpoint(_shared_id_pairs(rows, rules).select("a_station_key", "b_station_key"))
    active = edges.select(F.explode(F.array("a_station_key", "b_station_key")).alias("station_key")).distinct()
    rows = checkpoint(rows.join(active, "station_key", "left_semi"))
    pairs = distance_join(
        rows, rows, rules.alias_metres, "station_key", "station_key", keys=["station_type"]
    ).filter(F.col("a_idx") < F.col("b_idx"))
    return pairs.withColumn("source_id", F.array_min(F.array_intersect("a_ids", "b_ids")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b); the component is its least node.

    Labels move to the least neighbour and then to the label of that label, so
    the rounds grow with the logarithm of the longest chain.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    both = checkpoint(both.distinct())
    labels = checkpoint(
        both.groupBy("node").agg(F.min("other").alias("least")).select(
            "node", F.least("node", "least").alias("component")
        )
    )
    while True:
        around = (
            both.join(labels.withColumnRenamed("node", "other"), "other")
            .groupBy("node")
            .agg(F.min("component").alias("near"))
        )
        stepped = labels.join(around, "node").select(
            "node", "component", F.least("component", "near").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("jumped"))
        moved = checkpoint(
            stepped.join(jump, "next").select("node", "component", F.least("next", "jumped").alias("next"))
        )
        changed = not moved.filter("next <> component").isEmpty()
        labels = moved.select("node", F.col("next").alias("component"))
        if not changed:
            return labels


def greedy_groups(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Greedy merging in edge order under the full-diameter rule.

    Edges are taken by (source id, a, b); two groups merge when *every* pair
    across them is near.  An edge that fails once fails for good, as groups only
    grow.  So an edge can be taken as soon as it is the first live edge of both
    its groups, and many are taken per round.  "Every pair is near" is a count:
    the near pairs between two groups against the product of their sizes.
    Groups and counts are contracted after each round.

    Returns (labels: node -> group, accepted: source_id, a, b).
    """
    edge = F.when(F.col("source_id").isNotNull(), F.struct("source_id", "a", "b"))
    active = pairs.filter("source_id IS NOT NULL").select(F.explode(F.array("a", "b")).alias("node"))
    active = checkpoint(active.distinct())
    links = pairs.join(active.withColumnRenamed("node", "a"), "a", "left_semi").join(
        active.withColumnRenamed("node", "b"), "b", "left_semi"
    )
    links = checkpoint(
        links.select(F.col("a").alias("g"), F.col("b").alias("h"), F.lit(1).cast("long").alias("n"), edge.alias("edge"))
    )
    labels = active.select("node", F.col("node").alias("group"))
    accepted = None
    while True:
        sizes = labels.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
        live = (
            links.join(sizes.select(F.col("group").alias("g"), F.col("size").alias("g_size")), "g")
            .join(sizes.select(F.col("group").alias("h"), F.col("size").alias("h_size")), "h")
            .filter(F.col("n") == F.col("g_size") * F.col("h_size"))
            .select("g", "h", "n", "edge")
        )
        live = checkpoint(live)
        first = (
            live.filter("edge IS NOT NULL")
            .select(F.explode(F.array("g", "h")).alias("group"), "edge")
            .groupBy("group")
            .agg(F.min("edge").alias("first"))
        )
        chosen = (
            live.join(first.select(F.col("group").alias("g"), F.col("first").alias("g_first")), "g")
            .join(first.select(F.col("group").alias("h"), F.col("first").alias("h_first")), "h")
            .filter((F.col("edge") == F.col("g_first")) & (F.col("edge") == F.col("h_first")))
        )
        chosen = checkpoint(
            chosen.select(
                F.greatest("g", "h").alias("from"), F.least("g", "h").alias("to"), "edge"
            )
        )
        taken = chosen.select("edge.source_id", "edge.a", "edge.b")
        accepted = taken if accepted is None else accepted.unionByName(taken)
        if chosen.isEmpty():
            return labels, accepted
        moves = chosen.select("from", "to")

        def relabel(df: DataFrame, column: str, moves: DataFrame = moves) -> DataFrame:
            step = moves.select(F.col("from").alias(column), F.col("to").alias("__to"))
            return (
                df.join(step, column, "left")
                .withColumn(column, F.coalesce("__to", column))
                .drop("__to")
            )

        labels = checkpoint(relabel(labels, "group"))
        links = (
            relabel(relabel(live, "g"), "h")
            .filter(F.col("g") != F.col("h"))
            .groupBy(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"))
            .agg(F.sum("n").alias("n"), F.min("edge").alias("edge"))
        )


def merge_aliases(
    clustered: DataFrame, entities: DataFrame, rules: Rules = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """(re-keyed observations, accepted merges).

    A merged group takes key, name key and anchor of its member with the first
    trip; its ambiguity and its several-locations mark lapse.
    """
    near = near_pairs(entities, clustered, rules)
    pairs = checkpoint(
        near.select(F.col("a_idx").alias("a"), F.col("b_idx").alias("b"), "source_id")
    )
    labels, accepted = greedy_groups(pairs)
    order = clustered.groupBy("station_key").agg(
        F.min(F.struct("name_key", "cluster_no")).alias("node")
    )
    named = entities.select(
        "station_key", "station_name", "station_first_trip_at", "name_key", "anchor_lat", "anchor_lon"
    ).join(order, "station_key")
    members = labels.join(named, "node")
    heads = (
        members.groupBy("group")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min(
                F.struct("station_first_trip_at", "station_key", "name_key", "anchor_lat", "anchor_lon")
            ).alias("head"),
        )
        .filter("members > 1")
    )
    moved = checkpoint(members.join(heads, "group").select("station_key", "node", "head"))
    rekeyed = (
        clustered.join(moved.select("station_key", "head"), "station_key", "left")
        .withColumn("merged", F.col("head").isNotNull())
        .withColumn("key_name", F.coalesce("head.name_key", "name_key"))
        .withColumn("station_key", F.coalesce("head.station_key", "station_key"))
        .withColumn("anchor_lat", F.when(F.col("merged"), F.col("head.anchor_lat")).otherwise(F.col("anchor_lat")))
        .withColumn("anchor_lon", F.when(F.col("merged"), F.col("head.anchor_lon")).otherwise(F.col("anchor_lon")))
        .withColumn("ambiguous", F.col("ambiguous") & ~F.col("merged"))
        .withColumn("many_locations", F.col("many_locations") & ~F.col("merged"))
        .drop("head")
    )

    def side(name: str) -> DataFrame:
        return named.select(
            F.col("node").alias(name),
            F.col("station_key").alias(f"station_key_{name}"),
            F.col("station_name").alias(f"station_name_{name}"),
        )

    merges = (
        accepted.join(side("a"), "a")
        .join(side("b"), "b")
        .join(moved.select(F.col("node").alias("a"), "head"), "a")
        .select(
            "source_id",
            "station_key_a",
            "station_name_a",
            "station_key_b",
            "station_name_b",
            F.col("head.station_key").alias("merged_station_key"),
            F.lit("shared_source_id_and_within_35m").alias("reason"),
        )
    )
    return rekeyed, merges


def identity_review(entities: DataFrame, clustered: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Every pair of entities that share an id, once, with what that may mean.

    The result is all pairs by its meaning.  A busy id is split into blocks of
    pairs, and a pair is emitted only at its first shared id, so nothing has to
    be made unique afterwards.
    """
    rows = (
        entities.select(
            "station_key",
            "station_name",
            "station_first_trip_at",
            "station_lat",
            "station_lon",
            F.struct("station_first_trip_at", "station_key").alias("pos"),
        )
        .join(entity_ids(clustered), "station_key")
        .withColumn("source_id", F.explode("ids"))
    )
    pairs = pairs_within(checkpoint(rows), ["source_id"], "pos")
    first_shared = F.array_min(F.array_intersect("a.ids", "b.ids"))
    gap = haversine(
        F.col("a.station_lat"), F.col("a.station_lon"), F.col("b.station_lat"), F.col("b.station_lon")
    )
    return pairs.filter(first_shared == F.col("source_id")).select(
        "source_id",
        F.col("a.station_key").alias("station_key_a"),
        F.col("a.station_name").alias("station_name_a"),
        F.col("a.station_first_trip_at").alias("first_trip_at_a"),
        F.col("b.station_key").alias("station_key_b"),
        F.col("b.station_name").alias("station_name_b"),
        F.col("b.station_first_trip_at").alias("first_trip_at_b"),
        F.round(gap, 1).alias("distance_meters"),
        review_reason(gap, rules).alias("reason"),
    )


def flag_renames(entities: DataFrame, review: DataFrame) -> DataFrame:
    """Adds the flag ``possible_rename`` to both sides of such pairs."""
    renamed = (
        review.filter("reason = 'possible_rename_or_rack_conversion'")
        .select(F.explode(F.array("station_key_a", "station_key_b")).alias("station_key"))
        .distinct()
        .withColumn("__renamed", F.lit(True))
    )
    flags = F.split(F.col("quality_flags"), r" \| ")
    more = F.array_sort(
        F.array_distinct(F.filter(F.concat(flags, F.array(F.lit("possible_rename"))), lambda f: f != ""))
    )
    return (
        entities.join(renamed, "station_key", "left")
        .withColumn(
            "quality_flags",
            F.when(F.col("__renamed"), F.array_join(more, " | ")).otherwise(F.col("quality_flags")),
        )
        .drop("__renamed")
    )
