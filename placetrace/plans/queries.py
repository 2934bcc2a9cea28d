"""Queries over the check tables, one per operator, with their checking SQL.

Every query reads whole tables.  Counts are 64-bit, doubles are rounded, and
arrays are joined to text, so that both engines give comparable rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetrace.functions import geo, rules, text, times
from placetrace.operators import (
    aliases,
    audit,
    checks,
    coordinates,
    entities,
    matching,
    members,
    names,
    normalize,
    observe,
    profile,
    spatial,
)
from placetrace.operators.cluster import entity_key
from placetrace.plans import oracle_parts as o
from placetrace.plans import reports
from placetrace.plans.registry import ORACLE, QUERIES, register, rounded
from placetrace.plans.stages import Stages

__all__ = ["ORACLE", "QUERIES"]

OBS_KEYS = "archive, member, role, station_id, original_station_name"

# --- trips ------------------------------------------------------------------


@register(
    "first_trip",
    """SELECT s.station_key, s.station_id, s.station_name, round(s.station_lon, 8) AS station_lon,
      round(s.station_lat, 8) AS station_lat, f.at AS station_first_trip_at, s.quality_flags
    FROM entities s JOIN (SELECT station_key, min(first_at) AS at FROM clustered GROUP BY 1) f
      ON s.station_key = f.station_key ORDER BY 6, 1""",
)
def _(s: Stages) -> DataFrame:
    return rounded(
        entities.first_trip(s.entities(), s.clustered()), station_lon=8, station_lat=8
    )


def text_tables(s: Stages) -> list[DataFrame]:
    """Trips as text under three header families, one per table."""
    minute, second = "M/d/yyyy H:mm", "yyyy-MM-dd HH:mm:ss"
    lines, orders = s.table("lineitem"), s.table("orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    modern = joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ride_id"),
        F.date_format("o_orderdate", second).alias("started_at"),
        F.date_format("l_shipdate", second).alias("ended_at"),
        F.concat(F.lit("Stop  "), F.col("o_custkey")).alias("start_station_name"),
        F.format_string("%06d", "o_custkey").alias("start_station_id"),
        F.concat(F.lit(" Stop "), F.col("l_suppkey")).alias("end_station_name"),
        F.format_string("%06d", "l_suppkey").alias("end_station_id"),
        F.lit("41.9").alias("start_lat"),
        F.lit("-87.65").alias("start_lng"),
        F.when(F.col("l_linenumber") == 1, "41.9d").otherwise("41.95").alias("end_lat"),
        F.lit(" -87.6 ").alias("end_lng"),
    )
    legacy = s.table("events").select(
        F.col("event_id").cast("string").alias("trip_id"),
        F.date_format("ts", minute).alias("starttime"),
        F.when(F.col("event_type") == "error", "broken").otherwise(F.date_format("ts", second)).alias("stoptime"),
        F.col("user_id").cast("string").alias("from_station_id"),
        F.concat(F.lit("User\t"), F.col("user_id")).alias("from_station_name"),
        F.col("event_type").alias("to_station_id"),
        F.lit("   ").alias("to_station_name"),
    )
    verbose = orders.select(
        F.col("o_orderkey").cast("string").alias("01 - Rental Details Rental ID"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("01 - Rental Details Local Start Time"),
        F.date_format("o_orderdate", minute).alias("01 - Rental Details Local End Time"),
        F.col("o_orderstatus").alias("03 - Rental Start Station ID"),
        F.col("o_orderpriority").alias("03 - Rental Start Station Name"),
        F.col("o_custkey").cast("string").alias("02 - Rental End Station ID"),
        F.col("o_orderpriority").alias("02 - Rental End Station Name"),
    )
    return [modern, legacy, verbose]


@register(
    "schema_unify",
    """SELECT 'modern' AS schema, l_orderkey || '-' || l_linenumber AS trip_id, o_orderdate AS started_at,
      l_shipdate AS ended_at, lpad(o_custkey::VARCHAR, 6, '0') AS start_station_id,
      'Stop ' || o_custkey AS start_station_name, lpad(l_suppkey::VARCHAR, 6, '0') AS end_station_id,
      'Stop ' || l_suppkey AS end_station_name, 41.9::DOUBLE AS start_lat, -87.65::DOUBLE AS start_lon,
      CASE WHEN l_linenumber <> 1 THEN 41.95::DOUBLE END AS end_lat, -87.6::DOUBLE AS end_lon
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL
    SELECT 'legacy', event_id::VARCHAR, date_trunc('minute', ts),
      CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END, user_id::VARCHAR,
      'User ' || user_id, event_type, NULL, NULL, NULL, NULL, NULL FROM events
    UNION ALL
    SELECT 'legacy', o_orderkey::VARCHAR, date_trunc('day', o_orderdate), date_trunc('minute', o_orderdate),
      o_orderstatus, o_orderpriority, o_custkey::VARCHAR, o_orderpriority, NULL, NULL, NULL, NULL FROM orders""",
)
def _(s: Stages) -> DataFrame:
    return normalize.union_trips(text_tables(s))


@register(
    "timestamp_parse",
    """SELECT event_id, date_trunc(CASE WHEN event_id % 2 = 0 THEN 'second' ELSE 'minute' END, ts) AS parsed_at,
      strftime(ts, '%Y-%m') AS month FROM events""",
)
def _(s: Stages) -> DataFrame:
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm")
    kind = F.col("event_id") % 4
    written = F.coalesce(*[F.when(kind == i, F.date_format("ts", f)) for i, f in enumerate(formats)])
    parsed = s.table("events").select("event_id", times.parse_timestamp(written).alias("parsed_at"))
    return parsed.withColumn("month", times.month_text(F.col("parsed_at")))


@register(
    "clean_text",
    r"""SELECT doc_id, md5(c) AS cleaned_md5, length(c) AS cleaned_length FROM (
      SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS c FROM documents)""",
)
def _(s: Stages) -> DataFrame:
    cleaned = s.table("documents").select("doc_id", text.clean(F.col("text")).alias("c"))
    return cleaned.select(
        "doc_id", F.md5("c").alias("cleaned_md5"), F.length("c").cast("long").alias("cleaned_length")
    )


_SPELLING = (
    "CASE p_partkey % 5 WHEN 0 THEN '  ' || p_name || ' (*) ' WHEN 1 THEN upper(p_name) || '  (Temp)'"
    " WHEN 2 THEN 'Public Rack - ' || p_name WHEN 3 THEN p_name || ' (*) N' ELSE p_name END"
)


@register(
    "normalize_name",
    f"""SELECT p_partkey, {o.norm("n")} AS name_key, {o.display("n")} AS display_name,
      CASE WHEN contains({o.norm("n")}, 'public rack') THEN 'public_rack' ELSE 'station' END AS name_class
    FROM (SELECT p_partkey, {_SPELLING} AS n FROM part)""",
)
def _(s: Stages) -> DataFrame:
    spelled = s.table("part").select("p_partkey", F.expr(_SPELLING).alias("n"))
    key = text.normalize_name(F.col("n"))
    return spelled.select(
        "p_partkey",
        key.alias("name_key"),
        text.display_name(F.col("n")).alias("display_name"),
        text.name_class(key).alias("name_class"),
    )


@register(
    "duplicate_members",
    """SELECT doc_id, sha256(text) AS sha256,
      lag(source || '/' || doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS duplicate_of
    FROM documents""",
)
def _(s: Stages) -> DataFrame:
    hashed = s.table("documents").select(
        "doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), F.sha2("text", 256).alias("sha256")
    )
    copies = members.previous_copy(hashed, ["sha256"], "doc_id", "path", "duplicate_of")
    return copies.select("doc_id", "sha256", "duplicate_of")


@register(
    "content_fingerprint",
    """SELECT doc_id, octet_length(encode(text)) AS bytes, md5(text) AS md5, sha256(text) AS sha256
    FROM documents""",
)
def _(s: Stages) -> DataFrame:
    return members.fingerprint(s.table("documents"), "text", ["doc_id"])


# Measures of the profile as conditions on a trip; ``{e}`` stands for either end.
_TRIP_CONDITIONS = {
    "missing_trip_ids": "trip_id IS NULL",
    "reversed_trips": "started_at > ended_at",
    "zero_duration_trips": "started_at = ended_at",
}
_END_CONDITIONS = {
    "missing_{e}_id": "{e}_station_id IS NULL",
    "missing_{e}_name": "{e}_station_name IS NULL",
    "missing_{e}_coordinates": "{e}_lat + {e}_lon IS NULL",
    "invalid_{e}_coordinates": "NOT " + o.BOX.format(lat="{e}_lat", lon="{e}_lon") + " AND {e}_lat + {e}_lon IS NOT NULL",
}
_TIMES = {"start": "started_at", "end": "ended_at"}


def _profile_sql() -> str:
    conditions = dict(_TRIP_CONDITIONS)
    columns = ["archive", "member", "count(*) AS rows", "count(*) - count(DISTINCT trip_id) AS duplicate_or_missing_trip_ids"]
    for end, at in _TIMES.items():
        conditions |= {name.format(e=end): test.format(e=end) for name, test in _END_CONDITIONS.items()}
        conditions[f"invalid_{end}_time"] = f"{at} IS NULL"
        columns += [f"min({at}) AS earliest_{end}", f"max({at}) AS latest_{end}"]
        columns.append(f"count(DISTINCT {end}_station_id) AS distinct_{end}_ids")
    columns += [f"coalesce(sum(CASE WHEN {test} THEN 1 END), 0)::BIGINT AS {name}" for name, test in conditions.items()]
    return ", ".join(columns)


_PROFILE = _profile_sql()


@register("trip_profile", f"SELECT {_PROFILE} FROM trips GROUP BY archive, member")
def _(s: Stages) -> DataFrame:
    return s.profiles()


@register(
    "profile_totals",
    "SELECT "
    + ", ".join(f"sum({m})::BIGINT AS {m}" for m in profile.ADDITIVE)
    + f" FROM (SELECT {_PROFILE} FROM trips GROUP BY archive, member)",
)
def _(s: Stages) -> DataFrame:
    return profile.profile_totals(s.profiles())


@register(
    "rows_by_month",
    "SELECT strftime(started_at, '%Y-%m') AS month, count(*) AS rows FROM trips GROUP BY 1",
)
def _(s: Stages) -> DataFrame:
    return profile.rows_by_month(s.trips())


@register("rows_by_year", "SELECT year(started_at)::VARCHAR AS year, count(*) AS rows FROM trips GROUP BY 1")
def _(s: Stages) -> DataFrame:
    return profile.rows_by_year(profile.rows_by_month(s.trips()))


@register(
    "month_gaps",
    """SELECT strftime(m, '%Y-%m') AS month FROM (
      SELECT unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)),
        INTERVAL 1 MONTH)) AS m
      FROM (SELECT ts FROM events UNION ALL SELECT max(o_orderdate) FROM orders))
    WHERE strftime(m, '%Y-%m') NOT IN (SELECT strftime(ts, '%Y-%m') FROM events
      UNION ALL SELECT strftime(max(o_orderdate), '%Y-%m') FROM orders)""",
)
def _(s: Stages) -> DataFrame:
    last_order = s.table("orders").agg(F.max("o_orderdate").alias("started_at"))
    times_seen = s.table("events").select(F.col("ts").alias("started_at")).unionByName(last_order)
    return profile.month_gaps(profile.rows_by_month(times_seen))


@register(
    "endpoints",
    """SELECT trip_id, event_at, station_id, station_name, round(lat, 8) AS lat, round(lon, 8) AS lon,
      role, valid_trip, in_region, coarse, archive FROM ends""",
)
def _(s: Stages) -> DataFrame:
    ends = observe.endpoints(s.trips()).drop("member", "schema")
    return rounded(ends, lat=8, lon=8)


_SPOTS = ("coarse_lat", "coarse_lon", "lat", "lon", "lat_p05", "lat_p95", "lon_p05", "lon_p95")


@register(
    "observe_rollup",
    f"SELECT * REPLACE ({', '.join(f'round({c}, 8) AS {c}' for c in _SPOTS)}) FROM obs",
)
def _(s: Stages) -> DataFrame:
    return rounded(s.observations(), **{c: 8 for c in _SPOTS})


# --- identity of observations ----------------------------------------------


@register(
    "exclude_reasons",
    """SELECT coalesce(reason, 'kept') AS reason, count(*) AS rows, sum(endpoint_count)::BIGINT AS endpoints
    FROM located GROUP BY 1""",
)
def _(s: Stages) -> DataFrame:
    return (
        s.located()
        .groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("endpoint_count").alias("endpoints"))
    )


@register(
    "recover_names",
    f"SELECT {OBS_KEYS}, schema, station_name, name_key, name_recovered FROM recovered",
)
def _(s: Stages) -> DataFrame:
    return names.recover_names(s.observations()).select(
        *audit.GRAIN, "schema", "station_name", "name_key", "name_recovered"
    )


@register(
    "dispersion_reject",
    f"""SELECT {OBS_KEYS}, round(coordinate_dispersion_meters, 4) AS coordinate_dispersion_meters,
      coordinate_rejected, round(lat, 8) AS lat FROM scattered""",
)
def _(s: Stages) -> DataFrame:
    named = names.recover_names(s.observations())
    rejected = coordinates.reject_scattered(named)
    return rounded(
        rejected.select(*audit.GRAIN, "coordinate_dispersion_meters", "coordinate_rejected", "lat"),
        coordinate_dispersion_meters=4,
        lat=8,
    )


_PLACED = (
    "round(lat, 8) AS lat, round(lon, 8) AS lon, coordinate_source, coordinate_source_archive,"
    " coordinate_inferred"
)


def placed(df: DataFrame) -> DataFrame:
    columns = ["lat", "lon", "coordinate_source", "coordinate_source_archive", "coordinate_inferred"]
    return rounded(df.select(*audit.GRAIN, *columns), lat=8, lon=8)


@register("catalog_enrich", f"SELECT {OBS_KEYS}, {_PLACED} FROM cataloged")
def _(s: Stages) -> DataFrame:
    return placed(coordinates.use_catalog(s.named(), s.catalog()))


@register("arrival_override", f"SELECT {OBS_KEYS}, {_PLACED} FROM enriched")
def _(s: Stages) -> DataFrame:
    return placed(s.enriched())


@register("feed_coordinate_recovery", f"SELECT {OBS_KEYS}, {_PLACED} FROM located")
def _(s: Stages) -> DataFrame:
    return placed(s.located())


@register("catalog_fallback", "SELECT station_id, station_name, round(lat, 8) AS lat, round(lon, 8) AS lon FROM fallback")
def _(s: Stages) -> DataFrame:
    return rounded(coordinates.fallback_catalog(s.information(), s.city()), lat=8, lon=8)


_CELL = o.accepts("c.coarse_lat", "c.coarse_lon", "c.coordinate_count", "f.lat", "f.lon")


@register(
    "coarse_cell",
    f"""SELECT {", ".join("c." + k for k in OBS_KEYS.split(", "))}, f.station_id AS feed_station_id, {_CELL} AS inside
    FROM (SELECT r.* FROM recovered r) c JOIN (
      SELECT station_id, {o.norm("name")} AS key, lat, lon FROM information_rows) f ON c.name_key = f.key""",
)
def _(s: Stages) -> DataFrame:
    feed = s.information().select(
        F.col("station_id").alias("feed_station_id"),
        text.normalize_name(F.col("name")).alias("name_key"),
        F.col("lat").alias("f_lat"),
        F.col("lon").alias("f_lon"),
    )
    inside = geo.coarse_cell_contains(
        F.col("coarse_lat"), F.col("coarse_lon"), F.col("coordinate_count"), F.col("f_lat"), F.col("f_lon")
    )
    joined = names.recover_names(s.observations()).join(feed, "name_key")
    return joined.select(*audit.GRAIN, "feed_station_id", inside.alias("inside"))


# --- space ------------------------------------------------------------------


@register(
    "distance_join",
    f"""SELECT c.station_id, c.archive, c.station_name, f.feed_station_id,
      round({o.hav("c.lat", "c.lon", "f.lat", "f.lon")}, 4) AS distance_meters
    FROM catalog c CROSS JOIN feed_points f
    WHERE {o.hav("c.lat", "c.lon", "f.lat", "f.lon")} <= 150""",
)
def _(s: Stages) -> DataFrame:
    places = s.catalog().select("station_id", "archive", "station_name", "lat", "lon")
    feeds = s.feeds().select(
        "feed_station_id", F.col("station_lat").alias("lat"), F.col("station_lon").alias("lon")
    )
    joined = spatial.distance_join(places, feeds, 150.0, "station_id", "feed_station_id")
    return joined.select(
        F.col("a_station_id").alias("station_id"),
        F.col("a_archive").alias("archive"),
        F.col("a_station_name").alias("station_name"),
        F.col("b_feed_station_id").alias("feed_station_id"),
        F.round("distance_meters", 4).alias("distance_meters"),
    )


@register(
    "point_in_boundary",
    f"""SELECT station_id, archive, station_name, round(lat, 8) AS lat, round(lon, 8) AS lon,
      CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN coalesce(inside, false) END AS in_city
    FROM catalog LEFT JOIN ({o.inside_sql("catalog")}) USING (lat, lon)""",
)
def _(s: Stages) -> DataFrame:
    points = s.catalog().select("station_id", "archive", "station_name", "lat", "lon")
    return rounded(spatial.point_in_boundary(points, s.boundary()), lat=8, lon=8)


# --- entities ---------------------------------------------------------------


@register(
    "entity_key",
    f"SELECT station_id, archive, station_name, {o.entity_key('name_key', 'lat', 'lon')} AS station_key FROM catalog",
)
def _(s: Stages) -> DataFrame:
    key = entity_key(text.normalize_name(F.col("station_name")), F.col("lat"), F.col("lon"))
    return s.catalog().select("station_id", "archive", "station_name", key.alias("station_key"))


@register(
    "cluster_by_name",
    f"""SELECT {OBS_KEYS}, cluster_no, round(anchor_lat, 8) AS anchor_lat, round(anchor_lon, 8) AS anchor_lon,
      ambiguous, many_locations, coordinate_inferred, station_key FROM clusters""",
)
def _(s: Stages) -> DataFrame:
    columns = ["cluster_no", "anchor_lat", "anchor_lon", "ambiguous", "many_locations"]
    df = s.clusters().select(*audit.GRAIN, *columns, "coordinate_inferred", "station_key")
    return rounded(df, anchor_lat=8, anchor_lon=8)


_ENTITY = (
    "station_key, station_id, station_name, round(station_lon, 8) AS station_lon,"
    " round(station_lat, 8) AS station_lat, station_first_trip_at, station_first_departure_at,"
    " station_first_arrival_at, station_last_trip_at, reported_online_at, reported_online_at_latest,"
    " in_city, station_type, endpoint_count, coarse_coordinate_endpoint_count, source_id_count,"
    " source_ids, name_variants, quality_flags, first_trip_id, first_trip_role, first_trip_archive,"
    " first_trip_member, coordinate_source, coordinate_observed_month, coordinate_source_archive"
)


@register("entity_summary", f"SELECT {_ENTITY} FROM singles")
def _(s: Stages) -> DataFrame:
    return rounded(
        s.singles().drop("name_key", "anchor_lat", "anchor_lon"), station_lon=8, station_lat=8
    )


@register("entity_summary_by_name", f"SELECT {_ENTITY} FROM old_entities")
def _(s: Stages) -> DataFrame:
    return rounded(
        s.old_entities().drop("name_key", "anchor_lat", "anchor_lon"), station_lon=8, station_lat=8
    )


@register(
    "first_event_pick",
    """SELECT name_key, first_at, first_trip_id, role, archive, member FROM (
      SELECT *, row_number() OVER (PARTITION BY name_key
        ORDER BY first_at, coalesce(first_trip_id, ''), role, archive, member) AS place FROM kept)
    WHERE place = 1""",
)
def _(s: Stages) -> DataFrame:
    picked = s.kept().groupBy("name_key").agg(entities.first_event().alias("pick"))
    return picked.select(
        "name_key", *[f"pick.{c}" for c in ("first_at", "first_trip_id", "role", "archive", "member")]
    )


@register(
    "latest_identity_pick",
    """SELECT name_key, station_id, station_name, last_at FROM (
      SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY station_id IS NOT NULL DESC, last_at DESC,
        valid_endpoint_count DESC, coalesce(station_id, '') DESC, station_name DESC) AS place FROM kept)
    WHERE place = 1""",
)
def _(s: Stages) -> DataFrame:
    picked = s.kept().groupBy("name_key").agg(entities.latest_identity().alias("pick"))
    return picked.select("name_key", "pick.station_id", "pick.station_name", "pick.last_at")


@register(
    "coordinate_pick",
    f"""SELECT name_key, round(lat, 8) AS lat, round(lon, 8) AS lon, coordinate_count, last_at FROM (
      SELECT *, row_number() OVER (PARTITION BY name_key
        ORDER BY (coordinate_count >= 10 AND role = 'end') DESC, strftime(last_at, '%Y-%m') DESC,
          coordinate_count DESC, last_at DESC, archive DESC, member DESC, role DESC,
          coalesce(station_id, '') DESC, lat DESC, lon DESC) AS place
      FROM kept WHERE {o.box("lat", "lon")}) WHERE place = 1""",
)
def _(s: Stages) -> DataFrame:
    picked = s.kept().groupBy("name_key").agg(entities.best_coordinate().alias("pick"))
    picked = picked.filter("pick IS NOT NULL").select(
        "name_key", "pick.lat", "pick.lon", "pick.coordinate_count", "pick.last_at"
    )
    return rounded(picked, lat=8, lon=8)


@register(
    "newest_snapshot_pick",
    """SELECT station_id, station_name, round(lat, 8) AS lat, archive FROM (
      SELECT *, row_number() OVER (PARTITION BY station_id, station_name
        ORDER BY archive DESC, member DESC, lat DESC) AS place FROM catalog WHERE lat IS NOT NULL)
    WHERE place = 1""",
)
def _(s: Stages) -> DataFrame:
    newest = F.max_by("lat", F.struct("archive", "member", "lat"))
    picked = (
        s.catalog()
        .filter("lat IS NOT NULL")
        .groupBy("station_id", "station_name")
        .agg(newest.alias("lat"), F.max("archive").alias("archive"))
    )
    return rounded(picked, lat=8)


@register(
    "quality_flags",
    """SELECT flag, count(*) AS rows FROM (
      SELECT unnest(string_split(quality_flags, ' | ')) AS flag FROM flagged) WHERE flag <> '' GROUP BY 1""",
)
def _(s: Stages) -> DataFrame:
    return checks.frequencies(
        s.flagged().select(F.explode(text.split_list(F.col("quality_flags"))).alias("flag")), "flag"
    )


@register(
    "classify_entities",
    f"""SELECT feed_station_id, source,
      CASE WHEN {o.operational("name_key || ' ' || lower(short_name)")} THEN 'operational'
        WHEN contains(name_key, 'public rack') THEN 'public_rack' ELSE 'station' END AS station_type
    FROM feeds""",
)
def _(s: Stages) -> DataFrame:
    kind = text.entity_class(F.col("name_key"), F.array("short_name"))
    return s.feeds().select("feed_station_id", "source", kind.alias("station_type"))


@register(
    "online_dates",
    """SELECT station_key, reported_online_at, reported_online_at_latest,
      contains(quality_flags, 'conflicting_reported_online_dates') AS conflicting
    FROM entities WHERE reported_online_at IS NOT NULL""",
)
def _(s: Stages) -> DataFrame:
    return entities.online_dates(s.clustered(), s.catalog()).select(
        "station_key",
        "reported_online_at",
        "reported_online_at_latest",
        (F.col("online_days") > 1).alias("conflicting"),
    )


# --- aliases ----------------------------------------------------------------


@register(
    "alias_edges",
    """SELECT station_key_a, station_key_b, source_id, round(metres, 4) AS distance_meters FROM alias_pairs""",
)
def _(s: Stages) -> DataFrame:
    return aliases.alias_edges(s.singles(), s.clusters()).select(
        F.col("a_station_key").alias("station_key_a"),
        F.col("b_station_key").alias("station_key_b"),
        "source_id",
        F.round("distance_meters", 4).alias("distance_meters"),
    )


@register("alias_components", "SELECT node, min(other) AS component FROM reach GROUP BY node")
def _(s: Stages) -> DataFrame:
    edges = aliases.alias_edges(s.singles(), s.clusters())
    return aliases.connected_components(
        edges.select(F.col("a_station_key").alias("a"), F.col("b_station_key").alias("b"))
    )


@register("identity_review", "SELECT * FROM review")
def _(s: Stages) -> DataFrame:
    return s.review()


@register("merge_aliases", "SELECT * FROM merges")
def _(s: Stages) -> DataFrame:
    return s.merges()


@register("merged_entities", f"SELECT {_ENTITY} FROM entities")
def _(s: Stages) -> DataFrame:
    return rounded(
        s.entities().drop("name_key", "anchor_lat", "anchor_lon"), station_lon=8, station_lat=8
    )


# --- feeds ------------------------------------------------------------------


@register(
    "feed_rows",
    "SELECT * REPLACE (round(station_lat, 8) AS station_lat, round(station_lon, 8) AS station_lon) FROM feeds",
)
def _(s: Stages) -> DataFrame:
    return rounded(s.feeds(), station_lat=8, station_lon=8)


@register(
    "feed_id_sets",
    """SELECT 'information_without_status' AS check_name, count(*) AS violations FROM information_rows
      WHERE station_id NOT IN (SELECT 'P' || l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)
    UNION ALL
    SELECT 'status_without_information', count(*) FROM lineitem
      WHERE 'P' || l_partkey NOT IN (SELECT station_id FROM information_rows)
    UNION ALL
    SELECT 'repeated_status_ids', count(*) FROM (
      SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)""",
)
def _(s: Stages) -> DataFrame:
    shipped = s.table("lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("station_id"))
    return checks.id_set_differences(s.information(), shipped)


@register(
    "feed_validation",
    """SELECT unnest(['city_not_empty', 'city_not_truncated', 'city_unique_ids', 'city_coordinates_in_range'])
        AS check_name,
      unnest([(count(*) = 0)::BIGINT, (count(*) >= 10000)::BIGINT, count(*) - count(DISTINCT id),
        count(*) FILTER (WHERE NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180))])
        AS violations FROM city_rows
    UNION ALL
    SELECT unnest(['information_not_empty', 'information_not_truncated', 'information_unique_ids',
        'information_coordinates_in_range']),
      unnest([(count(*) = 0)::BIGINT, (count(*) >= 1000)::BIGINT, count(*) - count(DISTINCT station_id),
        count(*) FILTER (WHERE NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180))])
      FROM information_rows""",
)
def _(s: Stages) -> DataFrame:
    return checks.feed_checks(s.city(), "city", "id", "latitude", "longitude", page_size=10_000).unionByName(
        checks.feed_checks(s.information(), "information", "station_id", "lat", "lon", page_size=1000)
    )


_CANDIDATE = (
    "station_key, reference_name, reference_first_trip_at, reference_last_trip_at,"
    " reference_endpoint_count, source, feed_station_id, feed_name, feed_short_name, distance_meters,"
    " name_similarity, exact_name, shared_short_name, same_name_class, match_method, rank"
)


@register("match_candidates", f"SELECT {_CANDIDATE} FROM candidates")
def _(s: Stages) -> DataFrame:
    return matching.match_candidates(s.entities(), s.feeds())


@register(
    "levenshtein_similarity",
    """SELECT c.station_id, c.archive, c.station_name, i.station_id AS feed_station_id,
      round(1 - levenshtein(lower(c.station_name), lower(i.name))::DOUBLE
        / greatest(length(c.station_name), length(i.name)), 6) AS similarity
    FROM catalog c JOIN information_rows i ON c.station_id = i.short_name""",
)
def _(s: Stages) -> DataFrame:
    info = s.information().select(
        F.col("short_name").alias("station_id"), F.col("station_id").alias("feed_station_id"), "name"
    )
    close = text.levenshtein_similarity(F.lower("station_name"), F.lower("name"))
    joined = s.catalog().join(info, "station_id")
    return joined.select(
        "station_id", "archive", "station_name", "feed_station_id", F.round(close, 6).alias("similarity")
    )


@register(
    "resolve_matches",
    "SELECT source, station_key, feed_station_id, rank, match_method, accepted FROM resolved",
)
def _(s: Stages) -> DataFrame:
    return matching.resolve_matches(
        matching.match_candidates(s.entities(), s.feeds())
    ).select("source", "station_key", "feed_station_id", "rank", "match_method", "accepted")


@register(
    "feed_coverage",
    "SELECT * REPLACE (round(station_lat, 8) AS station_lat, round(station_lon, 8) AS station_lon) FROM covered",
)
def _(s: Stages) -> DataFrame:
    covered = matching.coverage(s.feeds(), s.matches(), s.entities())
    return rounded(covered, station_lat=8, station_lon=8)


@register(
    "feed_coverage_counts",
    """SELECT source, count(*) AS rows, count(*) FILTER (WHERE in_city) AS inside_city,
      count(station_key) AS matched, count(station_key) FILTER (WHERE in_city) AS inside_city_matched
    FROM covered GROUP BY source""",
)
def _(s: Stages) -> DataFrame:
    return matching.coverage_counts(matching.coverage(s.feeds(), s.matches(), s.entities()))


@register("earlier_same_name", "SELECT * FROM earlier")
def _(s: Stages) -> DataFrame:
    return matching.earlier_same_name(s.entities())


_REFERENCE = (
    "r.station_key, r.station_first_trip_at, r.source_ids, r.name_variants, r.first_trip_archive,"
    " r.opening_date_status, r.earlier_same_name_trip_at, r.service_date_review_reasons"
)
_INVENTORY = f"""SELECT c.id, c.station_name, c.short_name, c.total_docks, c.docks_in_service, c.status,
  round(c.latitude, 8) AS latitude, round(c.longitude, 8) AS longitude, c.region_id AS ward_region_id,
  (r.station_key IS NOT NULL) AS reference_matched, {_REFERENCE}
  FROM city_rows c LEFT JOIN public_rows r ON c.id = r.city_station_id"""


def inventory(s: Stages) -> DataFrame:
    fields = {c: c for c in s.city().columns} | {"region_id": "ward_region_id"}
    joined = matching.enrich_inventory(s.city(), s.public(), fields)
    return rounded(joined, latitude=8, longitude=8)


@register("inventory_left_join", _INVENTORY)
def _(s: Stages) -> DataFrame:
    return inventory(s)


_COUNTED = [
    "id", "station_name", "short_name", "total_docks", "docks_in_service", "status", "latitude",
    "longitude", "ward_region_id", "reference_matched", "station_key", "station_first_trip_at",
    "source_ids", "name_variants", "first_trip_archive", "opening_date_status",
    "earlier_same_name_trip_at", "service_date_review_reasons",
]


@register(
    "populated_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NOT NULL AND {c}::VARCHAR <> '')"
        f" AS populated_rows FROM ({_INVENTORY})"
        for c in _COUNTED
    ),
)
def _(s: Stages) -> DataFrame:
    return matching.populated_columns(inventory(s))


@register(
    "match_status",
    """SELECT station_key, city_station_id, city_match_method, city_match_distance_meters, city_status,
      gbfs_station_id, gbfs_station_name, gbfs_status, gbfs_station_type, current_feed_match_status,
      feed_snapshot_date FROM reconciled""",
)
def _(s: Stages) -> DataFrame:
    return s.reconciled().select(
        "station_key",
        *["city_station_id", "city_match_method", "city_match_distance_meters", "city_status"],
        *["gbfs_station_id", "gbfs_station_name", "gbfs_status", "gbfs_station_type"],
        *["current_feed_match_status", "feed_snapshot_date"],
    )


@register(
    "review_reasons",
    "SELECT station_key, earlier_same_name_trip_at, service_date_review_reasons, opening_date_status FROM reconciled",
)
def _(s: Stages) -> DataFrame:
    return s.reconciled().select(
        "station_key", "earlier_same_name_trip_at", "service_date_review_reasons", "opening_date_status"
    )


@register(
    "frequency_tables",
    """SELECT 'match_status' AS measure, current_feed_match_status AS value, count(*) AS rows FROM public_rows GROUP BY ALL
    UNION ALL SELECT 'station_type', station_type, count(*) FROM public_rows GROUP BY ALL
    UNION ALL SELECT 'review_reason', reason, count(*) FROM review GROUP BY ALL
    UNION ALL SELECT 'city_status', status, count(*) FROM feeds WHERE source = 'city' GROUP BY ALL
    UNION ALL SELECT 'operator_type', feed_station_type, count(*) FROM feeds WHERE source = 'gbfs' GROUP BY ALL""",
)
def _(s: Stages) -> DataFrame:
    def counted(measure: str, df: DataFrame, column: str) -> DataFrame:
        return checks.frequencies(df, column).select(
            F.lit(measure).alias("measure"), F.col(column).alias("value"), "rows"
        )

    feeds = s.feeds()
    return checks.all_checks(
        [
            counted("match_status", s.public(), "current_feed_match_status"),
            counted("station_type", s.public(), "station_type"),
            counted("review_reason", s.review(), "reason"),
            counted("city_status", feeds.filter("source = 'city'"), "status"),
            counted("operator_type", feeds.filter("source = 'gbfs'"), "feed_station_type"),
        ]
    )


# --- builds compared --------------------------------------------------------


_TRACED = """SELECT p.station_key AS old_station_key, p.station_name AS old_station_name,
      p.station_type AS old_station_type, p.station_first_trip_at AS old_first_trip_at,
      round(p.station_lat, 8) AS old_lat, round(p.station_lon, 8) AS old_lon,
      n.station_key AS new_station_key, n.station_name AS new_station_name,
      n.station_first_trip_at AS new_first_trip_at, round(n.station_lat, 8) AS new_lat,
      round(n.station_lon, 8) AS new_lon, n.in_city AS new_in_city, n.station_type AS new_station_type,
      k.shared AS shared_valid_endpoints,
      CASE WHEN n.station_lat IS NULL THEN 'retained_unlocated'
        WHEN n.station_type = 'operational' THEN 'excluded_operational'
        WHEN n.in_city IS FALSE THEN 'outside_city'
        WHEN p.station_key = n.station_key THEN 'same_key' ELSE 'reassigned_or_rekeyed' END AS disposition
    FROM old_entities p JOIN (SELECT old_station_key, new_station_key, sum(old_valid)::BIGINT AS shared
      FROM links GROUP BY 1, 2) k ON p.station_key = k.old_station_key
    JOIN entities n ON n.station_key = k.new_station_key"""


@register("lineage_compare", _TRACED)
def _(s: Stages) -> DataFrame:
    traced = audit.lineage(s.old_entities(), s.entities(), s.by_name(), s.clustered())
    return rounded(traced, old_lat=8, old_lon=8, new_lat=8, new_lon=8)


_ACCOUNTED = """SELECT * FROM (SELECT count(*) AS old_observation_rows, sum(valid_endpoint_count)::BIGINT AS old_endpoints
      FROM by_name), (SELECT count(*) AS joined_rows, sum(old_valid)::BIGINT AS joined_endpoints,
      count(*) FILTER (WHERE old_valid <> new_valid) AS changed_counts FROM links)"""


@register("lineage_accounting", _ACCOUNTED)
def _(s: Stages) -> DataFrame:
    return audit.accounting(s.by_name(), s.clustered())


_AUDITED = """SELECT 'every_old_observation_joined_once' AS check_name,
      abs((SELECT count(*) FROM by_name) - (SELECT count(*) FROM links)) AS violations
    UNION ALL SELECT 'every_old_valid_endpoint_preserved',
      abs((SELECT sum(valid_endpoint_count) FROM by_name) - (SELECT sum(old_valid) FROM links))::BIGINT
    UNION ALL SELECT 'no_observation_endpoint_counts_changed', count(*) FROM links WHERE old_valid <> new_valid
    UNION ALL SELECT 'every_old_entity_traced', count(*) FROM old_entities
      WHERE station_key NOT IN (SELECT old_station_key FROM links)"""


@register("audit_checks", _AUDITED)
def _(s: Stages) -> DataFrame:
    old, new = s.by_name(), s.clustered()
    traced = audit.lineage(s.old_entities(), s.entities(), old, new)
    return audit.audit_checks(s.old_entities(), old, new, traced)


@register(
    "build_types",
    """SELECT station_type, count(*) AS rows, count(*) FILTER (WHERE endpoint_count < 10) AS low_evidence_rows,
      count(*) FILTER (WHERE abs(station_lat - round(station_lat, 2)) < 1e-9
        AND abs(station_lon - round(station_lon, 2)) < 1e-9) AS coarse_grid_rows
    FROM old_entities GROUP BY 1""",
)
def _(s: Stages) -> DataFrame:
    return audit.build_counts(s.old_entities())


@register("date_risks", "SELECT * FROM risks")
def _(s: Stages) -> DataFrame:
    return audit.date_risks(s.public(), s.reconciled())


@register(
    "service_date_review",
    """SELECT p.station_key, p.station_name, p.station_type, p.station_first_trip_at,
      p.earlier_same_name_trip_at, k.earlier_unlocated_same_name, p.current_feed_match_status,
      p.service_date_review_reasons, p.first_trip_archive, p.first_trip_id
    FROM public_rows p LEFT JOIN risks k ON p.station_key = k.station_key
    WHERE p.service_date_review_reasons <> ''""",
)
def _(s: Stages) -> DataFrame:
    return audit.service_date_review(s.public(), audit.date_risks(s.public(), s.reconciled()))


_COARSE = """SELECT sum(coarse_coordinate_count)::BIGINT AS coarse_named_endpoints,
      count(*) FILTER (WHERE coarse_coordinate_count > 0) AS affected_observation_groups FROM clustered"""


@register("coarse_accounting", _COARSE)
def _(s: Stages) -> DataFrame:
    return audit.coarse_accounting(s.clustered())


_CROSSED = """SELECT * FROM (
      SELECT count(earlier_same_name_trip_at) AS earlier_same_name_history_rows,
        count(*) FILTER (WHERE year(station_first_trip_at) >= 1993 AND year(earlier_same_name_trip_at) < 1993)
          AS earlier_same_name_history_crosses,
        count(*) FILTER (WHERE service_date_review_reasons <> '') AS service_date_review_rows FROM public_rows),
      (SELECT count(*) AS earlier_unlocated_same_name_count,
        count(*) FILTER (WHERE year(station_first_trip_at) >= 1993 AND year(earlier_unlocated_same_name) < 1993)
          AS earlier_unlocated_same_name_crosses FROM risks)"""


@register("cutoff_crossing", _CROSSED)
def _(s: Stages) -> DataFrame:
    public = s.public()
    return audit.cutoff_crossing(public, 1993, audit.date_risks(public, s.reconciled()))


# --- checks -----------------------------------------------------------------


@register(
    "endpoint_reconciliation",
    """SELECT *, 2 * trip_rows - resolved_endpoints - excluded_endpoints AS unaccounted FROM
      (SELECT coalesce(sum(endpoint_count), 0)::BIGINT AS resolved_endpoints FROM kept),
      (SELECT coalesce(sum(endpoint_count), 0)::BIGINT AS excluded_endpoints FROM excluded),
      (SELECT count(*) AS trip_rows FROM trips)""",
)
def _(s: Stages) -> DataFrame:
    return checks.endpoint_reconciliation(s.trips(), s.kept(), s.excluded())


@register(
    "orphan_check",
    """SELECT station_key, count(*) AS observations FROM clustered
    WHERE station_key NOT IN (SELECT station_key FROM old_entities) GROUP BY 1""",
)
def _(s: Stages) -> DataFrame:
    orphans = checks.orphan_observations(s.clustered(), s.old_entities())
    return orphans.groupBy("station_key").agg(F.count(F.lit(1)).alias("observations"))


@register(
    "full_outer_mismatch",
    """SELECT coalesce(p.station_key, n.station_key) AS station_key, p.station_first_trip_at AS stated,
      n.station_first_trip_at AS derived
    FROM old_entities p FULL OUTER JOIN entities n ON p.station_key = n.station_key
    WHERE p.station_first_trip_at IS DISTINCT FROM n.station_first_trip_at""",
)
def _(s: Stages) -> DataFrame:
    return checks.first_date_mismatches(s.old_entities(), s.entities())


_SAMPLES = """SELECT DISTINCT station_key, station_name, station_first_trip_at, first_trip_archive,
    first_trip_member, first_trip_id, first_trip_role FROM (
  (SELECT * FROM public_rows ORDER BY station_first_trip_at, station_key LIMIT 2)
  UNION ALL (SELECT * FROM public_rows ORDER BY station_first_trip_at DESC, station_key LIMIT 2)
  UNION ALL (SELECT * FROM public_rows WHERE first_trip_role = 'end' ORDER BY station_first_trip_at, station_key LIMIT 1)
  UNION ALL (SELECT * FROM public_rows WHERE station_name IN ('Stop 7', 'Public Rack - Stop 3'))
  UNION ALL (SELECT * FROM public_rows WHERE station_first_trip_at >= '1994-01-01'
    AND earlier_same_name_trip_at < '1994-01-01' ORDER BY station_first_trip_at, station_key LIMIT 1))"""


def samples(s: Stages) -> DataFrame:
    return checks.sample_entities(s.public(), ["Stop 7", "Public Rack - Stop 3"], "1994-01-01")


@register("topk_samples", _SAMPLES)
def _(s: Stages) -> DataFrame:
    return samples(s).select(
        "station_key",
        "station_name",
        "station_first_trip_at",
        *["first_trip_archive", "first_trip_member", "first_trip_id", "first_trip_role"],
    )


@register(
    "spot_check",
    f"""SELECT s.*, round(p.station_lat, 8) AS station_lat, round(p.station_lon, 8) AS station_lon,
      coalesce(e.rows_found, 0) AS rows_found, coalesce(e.here.k, false) AS verified, e.here.i AS source_station_id,
      e.here.n AS source_station_name, round(e.here.y, 8) AS source_lat, round(e.here.x, 8) AS source_lon
    FROM ({_SAMPLES}) s JOIN public_rows p ON p.station_key = s.station_key LEFT JOIN (
      SELECT q.station_key, count(*) AS rows_found, min(CASE WHEN event_at = q.station_first_trip_at THEN
        struct_pack(k := true, i := e.station_id, n := e.station_name, y := lat, x := lon) END) AS here
      FROM public_rows q JOIN ends e ON e.archive = q.first_trip_archive AND e.member = q.first_trip_member
        AND e.trip_id = q.first_trip_id AND e.role = q.first_trip_role GROUP BY q.station_key) e
    ON e.station_key = s.station_key""",
)
def _(s: Stages) -> DataFrame:
    places = {name: 8 for name in ("station_lat", "station_lon", "source_lat", "source_lon")}
    return rounded(checks.spot_check(samples(s), s.trips()), **places)


_VALIDATION = f"""SELECT 'all_trip_rows_accounted_for' AS check_name,
      abs(2 * (SELECT count(*) FROM trips) - (SELECT sum(endpoint_count) FROM located))::BIGINT AS violations
    UNION ALL SELECT 'station_keys_unique', count(*) - count(DISTINCT station_key) FROM reconciled
    UNION ALL SELECT 'coordinates_and_dates_present_in_public_output', count(*) FROM public_rows
      WHERE station_lat IS NULL OR station_lon IS NULL OR station_first_trip_at IS NULL
    UNION ALL SELECT 'every_first_date_matches_observation_minimum', count(*) FROM reconciled r
      JOIN (SELECT station_key, min(first_at) AS at FROM clustered GROUP BY 1) f
      ON r.station_key = f.station_key WHERE r.station_first_trip_at <> f.at
    UNION ALL SELECT 'observation_mapping_has_no_orphans', count(*) FROM clustered
      WHERE station_key NOT IN (SELECT station_key FROM reconciled)
    UNION ALL SELECT 'accepted_merge_keys_exist', count(*) FROM merges
      WHERE merged_station_key NOT IN (SELECT station_key FROM reconciled)
    UNION ALL SELECT 'public_output_contains_only_public_city_locations', count(*) FROM public_rows
      WHERE in_city IS NOT TRUE OR station_type = 'operational'
    UNION ALL SELECT 'source_ids_are_text',
      CASE WHEN typeof(any_value(station_id)) = 'VARCHAR' THEN 0 ELSE 1 END FROM public_rows
    UNION ALL SELECT 'query_reproduces_reference_dates', count(*) FROM public_rows r
      FULL OUTER JOIN (SELECT station_key, min(first_at) AS at FROM clustered
        WHERE station_key IN (SELECT station_key FROM public_rows) GROUP BY 1) f
      ON r.station_key = f.station_key WHERE r.station_first_trip_at IS DISTINCT FROM f.at
    UNION ALL SELECT 'every_month_in_observed_coverage_present',
      date_diff('month', min(started_at), max(started_at)) + 1
        - count(DISTINCT strftime(started_at, '%Y-%m')) FROM trips
    UNION ALL SELECT 'accepted_feed_matches_one_to_one',
      count(*) - count(DISTINCT source || '/' || feed_station_id) FROM resolved WHERE accepted
    UNION ALL SELECT 'every_feed_row_accounted_for',
      (SELECT count(*) FROM feeds) - (SELECT count(*) FROM covered)
    UNION ALL SELECT 'no_fuzzy_only_matches_accepted', count(*) FROM resolved WHERE accepted AND rank >= 99
    UNION ALL SELECT 'all_opening_dates_explicitly_unverified', count(*) FROM reconciled
      WHERE opening_date_status <> 'unverified_first_trip_proxy'
    UNION ALL SELECT 'inventory_preserves_city_rows', (SELECT count(*) FROM city_rows)
      - (SELECT count(*) FROM city_rows c LEFT JOIN public_rows r ON c.id = r.city_station_id)
    UNION ALL SELECT 'inventory_preserves_city_cells', count(*) FROM ({_INVENTORY}) i JOIN city_rows c ON c.id = i.id
      WHERE (i.station_name, i.short_name, i.total_docks, i.docks_in_service, i.status)
        IS DISTINCT FROM (c.station_name, c.short_name, c.total_docks, c.docks_in_service, c.status)
    UNION ALL SELECT 'inventory_joins_published_reference_exactly', count(*) FROM (
      SELECT city_station_id FROM public_rows WHERE city_station_id IS NOT NULL
      GROUP BY 1 HAVING count(*) > 1)"""


def validation(s: Stages) -> DataFrame:
    plain, feeds, candidates, public = s.reconciled(), s.feeds(), s.candidates(), s.public()
    covered = matching.coverage(feeds, candidates, plain)
    joined = matching.enrich_inventory(s.city(), public)
    return checks.all_checks(
        [
            checks.build_checks(plain, public, s.clustered(), s.excluded(), s.trips(), s.merges()),
            checks.reconciliation_checks(plain, feeds, candidates, covered),
            checks.inventory_checks(joined, s.city(), public),
        ]
    )


@register("validation_checks", _VALIDATION)
def _(s: Stages) -> DataFrame:
    return validation(s)



# Published figures: how many rows meet a condition, and other aggregates.
_PUBLIC_COUNTS = {
    "public_rows": "true",
    "public_racks": "station_type = 'public_rack'",
    "low_evidence_rows": "endpoint_count < 10",
    "with_online_dates": "reported_online_at IS NOT NULL",
    "conflicting_online_dates": "quality_flags LIKE '%conflicting_reported_online_dates%'",
    "arrival_precedes_departure": "station_first_departure_at > station_first_arrival_at",
}
_PUBLIC_OTHERS = {
    "unique_keys": "count(DISTINCT station_key)",
    "unique_current_source_ids": "count(DISTINCT station_id)",
    "earliest_station_trip": "min(station_first_trip_at)",
    "latest_station_trip": "max(station_last_trip_at)",
}
_PUBLIC = [f"coalesce(sum(CASE WHEN {test} THEN 1 END), 0)::BIGINT AS {name}" for name, test in _PUBLIC_COUNTS.items()]
_PUBLIC += [f"{value} AS {name}" for name, value in _PUBLIC_OTHERS.items()]


@register("public_metrics", f"SELECT {', '.join(_PUBLIC)} FROM public_rows")
def _(s: Stages) -> DataFrame:
    return checks.public_metrics(s.public())


@register(
    "build_summary",
    """SELECT * FROM (SELECT count(DISTINCT archive) AS archive_count, count(*) AS trip_rows FROM trips),
      (SELECT count(*) AS all_entities,
        count(*) FILTER (WHERE coalesce(in_city, false) AND station_type <> 'operational') AS public_entities,
        count(*) FILTER (WHERE station_type = 'operational') AS operational_entities,
        count(*) FILTER (WHERE NOT in_city) AS outside_entities,
        count(*) FILTER (WHERE in_city IS NULL) AS unlocated_entities FROM entities),
      (SELECT sum(endpoint_count)::BIGINT AS excluded_endpoints FROM excluded),
      (SELECT sum(endpoint_count)::BIGINT AS resolved_endpoints,
        sum(valid_endpoint_count)::BIGINT AS valid_resolved_endpoints FROM clustered),
      (SELECT count(*) AS accepted_alias_merges FROM merges), (SELECT count(*) AS identity_review_pairs FROM review)""",
)
def _(s: Stages) -> DataFrame:
    return checks.build_summary(
        s.entities(), s.clustered(), s.excluded(), s.trips(), s.merges(), s.review()
    )


@register(
    "unlocated_export",
    "SELECT station_key, station_name, source_ids, station_first_trip_at FROM reconciled WHERE station_lat IS NULL",
)
def _(s: Stages) -> DataFrame:
    return s.reconciled().filter("station_lat IS NULL").select(
        "station_key", "station_name", "source_ids", "station_first_trip_at"
    )


# --- reports ----------------------------------------------------------------


def _figures(section: str, sql: str, columns: list[str], times: tuple[str, ...] = ()) -> str:
    """SQL: a row (section, measure, value) for each column of a table of one row."""
    cells = [f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if c in times else f"{c}::VARCHAR" for c in columns]
    names = ", ".join(f"'{c}'" for c in columns)
    return f"SELECT '{section}' AS section, unnest([{names}]) AS measure, unnest([{', '.join(cells)}]) AS value FROM ({sql})"


def _listed(section: str, sql: str, measure: str, value: str) -> str:
    return f"SELECT '{section}' AS section, {measure} AS measure, {value}::VARCHAR AS value FROM ({sql})"


def _counted(section: str, source: str, column: str) -> str:
    return _listed(section, f"SELECT {column} AS m, count(*) AS n FROM {source} GROUP BY 1", "m", "n")


_TOTALS = ", ".join(f"sum({m})::BIGINT AS {m}" for m in profile.ADDITIVE)
_METRICS = [*_PUBLIC_COUNTS, *_PUBLIC_OTHERS]


@register(
    "validation_report",
    " UNION ALL ".join(
        [
            _listed("checks", _VALIDATION, "check_name", "violations"),
            _figures("metrics", f"SELECT {', '.join(_PUBLIC)} FROM public_rows", _METRICS, tuple(_METRICS[-2:])),
            _figures(
                "trip_totals",
                f"SELECT {_TOTALS} FROM (SELECT {_PROFILE} FROM trips GROUP BY archive, member)",
                list(profile.ADDITIVE),
            ),
            _listed(
                "rows_by_month",
                "SELECT strftime(started_at, '%Y-%m') AS m, count(*) AS n FROM trips GROUP BY 1",
                "m",
                "n",
            ),
        ]
    ),
)
def _(s: Stages) -> DataFrame:
    return reports.validation_report(validation(s), s.public(), s.profiles(), profile.rows_by_month(s.trips()))


_COVERED = """SELECT source, count(*) AS rows, count(*) FILTER (WHERE in_city) AS inside_city,
  count(station_key) AS matched, count(station_key) FILTER (WHERE in_city) AS inside_city_matched FROM covered GROUP BY source"""


@register(
    "reconciliation_report",
    " UNION ALL ".join(
        [
            *[_listed(f"feed_coverage_{n}", _COVERED, "source", n) for n in ("rows", "inside_city", "matched", "inside_city_matched")],
            _counted("city_status", "(SELECT * FROM covered WHERE source = 'city')", "status"),
            _counted("operator_type", "(SELECT * FROM covered WHERE source = 'gbfs')", "feed_station_type"),
            _counted("match_status", "public_rows", "current_feed_match_status"),
            _counted("station_type", "public_rows", "station_type"),
            _figures(
                "current_stations",
                f"SELECT count(*) AS rows, count(*) FILTER (WHERE reference_matched) AS matched,"
                f" count(*) FILTER (WHERE NOT reference_matched) AS unmatched FROM ({_INVENTORY})",
                ["rows", "matched", "unmatched"],
            ),
            *[
                _figures("populated_cells", f"SELECT count(*) FILTER (WHERE {c} IS NOT NULL AND {c}::VARCHAR <> '') AS {c} FROM ({_INVENTORY})", [c])
                for c in _COUNTED
            ],
            _listed("checks", _VALIDATION, "check_name", "violations"),
        ]
    ),
)
def _(s: Stages) -> DataFrame:
    covered = matching.coverage(s.feeds(), s.matches(), s.entities())
    return reports.reconciliation_report(s.public(), covered, inventory(s), validation(s))


def _build_sql(source: str) -> str:
    return f"""SELECT station_type, count(*) AS rows, count(*) FILTER (WHERE endpoint_count < 10) AS low_evidence_rows,
      count(*) FILTER (WHERE abs(station_lat - round(station_lat, 2)) < 1e-9
        AND abs(station_lon - round(station_lon, 2)) < 1e-9) AS coarse_grid_rows FROM {source} GROUP BY 1"""


_CROSSING = [
    "earlier_same_name_history_rows", "earlier_same_name_history_crosses", "service_date_review_rows",
    "earlier_unlocated_same_name_count", "earlier_unlocated_same_name_crosses",
]
_ACCOUNTING = ["old_observation_rows", "old_endpoints", "joined_rows", "joined_endpoints", "changed_counts"]


@register(
    "comparison_report",
    " UNION ALL ".join(
        [
            *[
                _listed(f"{build}_{n}", _build_sql(source), "station_type", n)
                for build, source in (("old", "old_entities"), ("new", "entities"))
                for n in ("rows", "low_evidence_rows", "coarse_grid_rows")
            ],
            _counted("dispositions", f"({_TRACED})", "disposition"),
            _figures("date_risks", _CROSSED, _CROSSING),
            _figures("coarse", _COARSE, ["coarse_named_endpoints", "affected_observation_groups"]),
            _figures("accounting", _ACCOUNTED, _ACCOUNTING),
            _listed("checks", _AUDITED, "check_name", "violations"),
        ]
    ),
)
def _(s: Stages) -> DataFrame:
    return reports.comparison_report(
        s.old_entities(), s.by_name(), s.entities(), s.clustered(), s.public(), s.reconciled(), 1993
    )


import placetrace.plans.file_queries  # noqa: E402, F401  registers queries over written files
