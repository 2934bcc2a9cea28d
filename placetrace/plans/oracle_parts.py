"""Common table expressions of the checking queries, in dependency order.

They state the rules the plain way - sequential walks, window functions, brute
force - and so do not share their method with the Spark operators.
"""

from __future__ import annotations

import re

from placetrace.params import DEFAULT
from placetrace.plans import adapters

BOX = "({lat} BETWEEN 41.4 AND 42.3 AND {lon} BETWEEN -88.1 AND -87.3)"


def box(lat: str, lon: str) -> str:
    return "coalesce(" + BOX.format(lat=lat, lon=lon) + ", false)"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    dlat, dlon = f"sin(radians({lat2} - {lat1}) / 2)", f"sin(radians({lon2} - {lon1}) / 2)"
    h = f"({dlat} * {dlat} + cos(radians({lat1})) * cos(radians({lat2})) * ({dlon} * {dlon}))"
    return f"(CASE WHEN {h} IS NULL THEN NULL ELSE 12742000.0 * asin(least(1.0, sqrt({h}))) END)"


def norm(text: str) -> str:
    spaced = rf"trim(regexp_replace(coalesce({text}, ''), '\s+', ' ', 'g'))"
    return rf"trim(regexp_replace(lower({spaced}), '\s*\((?:\*|temp)\)\s*$', ''))"


def display(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s*\((?:\*|temp)\)\s*$', '', 'i'))"


def placeholder(key: str) -> str:
    return rf"regexp_full_match({key}, '[\d.]+')"


def operational(words: str) -> str:
    return f"regexp_matches({words}, '{DEFAULT.operational_regex}')"


def accepts(coarse_lat: str, coarse_lon: str, count: str, lat: str, lon: str) -> str:
    near_lat = f"greatest({coarse_lat} - 0.005::DOUBLE, least({lat}, {coarse_lat} + 0.005::DOUBLE))"
    near_lon = f"greatest({coarse_lon} - 0.005::DOUBLE, least({lon}, {coarse_lon} + 0.005::DOUBLE))"
    gap = hav(near_lat, near_lon, lat, lon)
    return f"({coarse_lat} IS NULL OR coalesce({count}, 0) > 0 OR {gap} <= 150)"


def edges_values() -> str:
    rows = []
    for polygon, ring, points in adapters.BOUNDARY_RINGS:
        for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
            rows.append(
                f"('{polygon}', {ring}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)"
            )
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(polygon, ring, x1, y1, x2, y2)"


def inside_sql(points: str) -> str:
    """(lat, lon, inside) of the distinct points of a relation, by brute force."""
    return f"""
      SELECT lat, lon, bool_or(odd OR touches) AS inside FROM (
        SELECT p.lat, p.lon, e.polygon,
          count(*) FILTER (WHERE (e.y1 > p.lat) <> (e.y2 > p.lat)
            AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1) % 2 = 1 AS odd,
          bool_or((e.x2 - e.x1) * (p.lat - e.y1) = (e.y2 - e.y1) * (p.lon - e.x1)
            AND p.lon BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
            AND p.lat BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)) AS touches
        FROM (SELECT DISTINCT lat, lon FROM {points} WHERE lat IS NOT NULL AND lon IS NOT NULL) p
        CROSS JOIN edges e GROUP BY ALL) GROUP BY ALL"""


def entity_key(name: str, lat: str, lon: str) -> str:
    def text(value: str) -> str:
        return f"coalesce(CAST(CAST({value} AS DECIMAL(12,8)) AS VARCHAR), 'none')"

    return (
        f"'place_' || substring(sha256({name} || '|' || {text(lat)} || '|' || {text(lon)}), 1, 16)"
    )


def flag(name: str, condition: str) -> str:
    return f"CASE WHEN {condition} THEN '{name}' END"


def entities_sql(clustered: str, merged: bool = False) -> str:
    """The entity summary of a clustered relation; a merged one has a ``key_name`` and a mark of its own."""
    first = (
        "struct_pack(a := first_at, b := coalesce(first_trip_id, ''), c := role,"
        " d := archive, e := member)"
    )
    latest = (
        "struct_pack(a := station_id IS NOT NULL, b := last_at, c := valid_endpoint_count,"
        " d := coalesce(station_id, ''), e := station_name)"
    )
    spot = (
        "struct_pack(a := coordinate_count >= 10 AND role = 'end', b := strftime(last_at, '%Y-%m'),"
        " c := coordinate_count, d := last_at, e := archive, f := member, g := role,"
        " h := coalesce(station_id, ''), i := lat, j := lon)"
    )
    words = "name_key || ' ' || lower(coalesce(array_to_string(ids, ' '), ''))"
    flags = ", ".join(
        [
            flag("fewer_than_10_endpoints", "endpoint_count < 10"),
            flag("missing_coordinates", "spot IS NULL"),
            flag("ambiguous_historical_location", "is_ambiguous"),
            flag("historical_location_inferred", "is_inferred"),
            flag("historical_coordinates_matched_by_id", "by_id_only"),
            flag("scattered_gps_rejected", "is_scattered"),
            flag("coarse_trip_coordinates_not_used", "has_coarse"),
            flag("location_inferred_from_current_feed", "from_feed"),
            flag("missing_name_recovered", "has_recovered"),
            flag("multiple_source_ids", "len(ids) > 1"),
            flag("missing_source_id", "ids IS NULL"),
            flag("first_archive_day", "CAST(first.first_at AS DATE) = DATE '2013-06-27'"),
            flag("operational_station", operational(words)),
            flag("conflicting_reported_online_dates", "online_days > 1"),
            flag("name_has_multiple_locations", "several"),
            *([flag("nearby_name_aliases_merged", "was_merged")] if merged else []),
        ]
    )
    return f"""
      SELECT station_key, latest.station_id AS station_id,
        {display("latest.station_name")} AS station_name, lon AS station_lon, lat AS station_lat,
        first.first_at AS station_first_trip_at, station_first_departure_at,
        station_first_arrival_at, station_last_trip_at, reported_online_at,
        reported_online_at_latest,
        CASE WHEN spot IS NOT NULL THEN coalesce(inside, false) END AS in_city,
        CASE WHEN {operational(words)} THEN 'operational'
             WHEN contains(name_key, 'public rack') THEN 'public_rack' ELSE 'station' END AS station_type,
        endpoint_count, coarse_coordinate_endpoint_count,
        coalesce(len(ids), 0)::BIGINT AS source_id_count,
        coalesce(array_to_string(ids, ' | '), '') AS source_ids,
        array_to_string(names, ' | ') AS name_variants,
        array_to_string(list_sort(list_filter([{flags}], lambda f: f IS NOT NULL)), ' | ') AS quality_flags,
        first.first_trip_id AS first_trip_id, first.role AS first_trip_role,
        first.archive AS first_trip_archive, first.member AS first_trip_member,
        coalesce(spot.coordinate_source, 'missing') AS coordinate_source,
        CASE WHEN spot.coordinate_source NOT LIKE 'historical\\_%' ESCAPE '\\'
              AND spot.coordinate_source NOT LIKE 'current\\_feed\\_%' ESCAPE '\\'
             THEN strftime(spot.last_at, '%Y-%m') END AS coordinate_observed_month,
        spot.coordinate_source_archive AS coordinate_source_archive,
        name_key, anchor_lat, anchor_lon, ids, names
      FROM (
        SELECT g.*, g.spot.lat AS lat, g.spot.lon AS lon, o.* EXCLUDE (station_key)
        FROM (
          SELECT station_key, min({'key_name' if merged else 'name_key'}) AS name_key, min(anchor_lat) AS anchor_lat,
            min(anchor_lon) AS anchor_lon,
            arg_min(struct_pack(first_at := first_at, first_trip_id := first_trip_id, role := role,
              archive := archive, member := member), {first}) AS first,
            arg_max(struct_pack(station_id := station_id, station_name := station_name), {latest}) AS latest,
            arg_max(struct_pack(lat := lat, lon := lon, last_at := last_at,
              coordinate_source := coordinate_source,
              coordinate_source_archive := coordinate_source_archive), {spot})
              FILTER (WHERE {box("lat", "lon")}) AS spot,
            min(first_at) FILTER (WHERE role = 'start') AS station_first_departure_at,
            min(first_at) FILTER (WHERE role = 'end') AS station_first_arrival_at,
            max(last_at) AS station_last_trip_at,
            sum(valid_endpoint_count)::BIGINT AS endpoint_count,
            sum(coarse_coordinate_count)::BIGINT AS coarse_coordinate_endpoint_count,
            list_sort(list(DISTINCT station_id) FILTER (WHERE station_id IS NOT NULL)) AS ids,
            list_sort(list(DISTINCT station_name)) AS names,
            bool_or(ambiguous) AS is_ambiguous, bool_or(coordinate_inferred) AS is_inferred,
            bool_or(coordinate_source = 'historical_lookup_id_only') AS by_id_only,
            bool_or(coordinate_rejected) AS is_scattered,
            bool_or(coarse_coordinate_count > 0) AS has_coarse,
            bool_or(starts_with(coordinate_source, 'current_feed_')) AS from_feed,
            bool_or(name_recovered) AS has_recovered, bool_or(many_locations) AS several
            {', bool_or(merged) AS was_merged' if merged else ''}
          FROM {clustered} GROUP BY station_key) g
        LEFT JOIN (
          SELECT e.station_key, min(c.reported_online_at) AS reported_online_at,
            max(c.reported_online_at) AS reported_online_at_latest,
            count(DISTINCT CAST(c.reported_online_at AS DATE)) AS online_days
          FROM (SELECT DISTINCT station_key, anchor_lat, anchor_lon, station_id, name_key FROM {clustered}) e
          JOIN catalog c ON c.station_id = e.station_id AND c.name_key = e.name_key
            AND c.reported_online_at IS NOT NULL
            AND (e.anchor_lat IS NULL OR NOT {box("c.lat", "c.lon")}
              OR {hav("c.lat", "c.lon", "e.anchor_lat", "e.anchor_lon")} <= 150)
          GROUP BY e.station_key) o ON g.station_key = o.station_key
      ) LEFT JOIN ({inside_sql(f"(SELECT lat, lon FROM {clustered})")}) USING (lat, lon)"""


SUPPORT = (
    "valid_endpoint_count DESC, role <> 'end', first_at, archive, coalesce(station_id, ''), member,"
    " coalesce(station_name, ''), coalesce(original_station_name, ''), lat, lon"
)
FILE_ORDER = (
    "archive, member, coalesce(station_id, ''), role, coalesce(station_name, ''),"
    " coalesce(original_station_name, '')"
)

PARTS: dict[str, str] = {}
RECURSIVE = {"walk", "attach", "reach", "merge_walk"}

PARTS["trips"] = f"SELECT * FROM {adapters.trips_sql()}"
PARTS["catalog"] = (
    f"SELECT *, {norm('station_name')} AS name_key FROM {adapters.sql(adapters.CATALOG, 'customer')}"
)
PARTS["city_rows"] = f"SELECT * FROM {adapters.sql(adapters.CITY, 'supplier')}"
PARTS["information_rows"] = f"SELECT * FROM {adapters.sql(adapters.INFORMATION, 'part')}"
PARTS["status_rows"] = f"SELECT * FROM {adapters.sql(adapters.STATUS, 'part')}"
PARTS["edges"] = edges_values()


def _ends_sql() -> str:
    """One branch per trip end: the columns of that end under names without it."""
    common = ["archive", "member", "schema", "trip_id", "NOT (started_at > ended_at) AS ordered"]
    branches = []
    for role, at in (("start", "started_at"), ("end", "ended_at")):
        own = [f"{role}_{name} AS {name}" for name in ("station_id", "station_name", "lat", "lon")]
        branches.append(f"SELECT {', '.join([*common, *own])}, {at} AS event_at, '{role}' AS role FROM trips")
    grid = " AND ".join(f"abs({axis} * 100 - round({axis} * 100)) < 1e-7" for axis in ("lat", "lon"))
    return f"""SELECT * EXCLUDE (ordered), coalesce(ordered, false) AS valid_trip, {box("lat", "lon")} AS in_region,
      coalesce({grid}, false) AS coarse FROM ({' UNION ALL '.join(branches)})"""


def _obs_sql() -> str:
    """Counts by place from per-end columns; quantiles by the ranks of sorted lists."""
    by = "archive, member, schema, station_id, station_name, role"
    lists = [f"list_sort(list({axis}) FILTER (WHERE kind = '{kind}')) AS {kind}_{axis}s" for kind in ("fine", "coarse") for axis in ("lat", "lon")]

    def quantile(values: str, p: float) -> str:
        place = f"({p} * (len({values}) - 1))"
        low, high = (f"{values}[1 + {side}({place})::BIGINT]" for side in ("floor", "ceil"))
        return f"{low} + ({high} - {low}) * ({place} - floor({place}))"

    spots = [f"{quantile(f'coarse_{axis}s', 0.5)} AS coarse_{axis}" for axis in ("lat", "lon")]
    for axis in ("lat", "lon"):
        spots += [f"{quantile(f'fine_{axis}s', p)} AS {axis}{name}" for name, p in (("", 0.5), ("_p05", 0.05), ("_p95", 0.95))]
    return f"""
      SELECT * EXCLUDE (fine_lats, fine_lons, coarse_lats, coarse_lons, firsts), {norm("station_name")} AS name_key,
        firsts.id AS first_trip_id, coalesce(len(fine_lats), 0)::BIGINT AS coordinate_count,
        coalesce(len(coarse_lats), 0)::BIGINT AS coarse_coordinate_count, {", ".join(spots)}
      FROM (SELECT {by}, count(*) AS endpoint_count, count(used_at) AS valid_endpoint_count, min(used_at) AS first_at,
          max(used_at) AS last_at, min(CASE WHEN trip_id IS NOT NULL AND used_at IS NOT NULL
            THEN {{'at': used_at, 'id': trip_id}} END) AS firsts, {", ".join(lists)}
        FROM (SELECT *, CASE WHEN valid_trip THEN event_at END AS used_at,
            CASE WHEN NOT (valid_trip AND in_region) THEN 'none' WHEN coarse THEN 'coarse' ELSE 'fine' END AS kind FROM ends)
        GROUP BY ALL)"""


PARTS["ends"] = _ends_sql()
PARTS["obs"] = _obs_sql()
PARTS["single_names"] = f"""
  SELECT archive, station_id, min(name_key) AS only_key, min(station_name) AS only_name FROM obs
  WHERE station_id IS NOT NULL AND name_key <> '' AND NOT {placeholder("name_key")}
  GROUP BY archive, station_id HAVING count(DISTINCT name_key) = 1"""
_LACKS = f"((o.name_key = '' OR {placeholder('o.name_key')}) AND s.only_key IS NOT NULL)"
PARTS["recovered"] = f"""
  SELECT o.* EXCLUDE (station_name, name_key), o.station_name AS original_station_name,
    {_LACKS} AS name_recovered,
    CASE WHEN {_LACKS} THEN s.only_name ELSE o.station_name END AS station_name,
    CASE WHEN {_LACKS} THEN s.only_key ELSE o.name_key END AS name_key
  FROM obs o LEFT JOIN single_names s ON o.archive = s.archive AND o.station_id = s.station_id"""
PARTS["scattered"] = f"""
  SELECT * EXCLUDE (lat, lon), CASE WHEN NOT coordinate_rejected THEN lat END AS lat,
    CASE WHEN NOT coordinate_rejected THEN lon END AS lon
  FROM (SELECT *, coalesce(coordinate_dispersion_meters > 300, false) AS coordinate_rejected
    FROM (SELECT *, {hav("lat_p05", "lon_p05", "lat_p95", "lon_p95")} AS coordinate_dispersion_meters
      FROM recovered))"""


def _spots(keys: str) -> str:
    order = "archive, member, lat, lon"
    return f"""
  SELECT {keys}, max({hav("old_lat", "old_lon", "lat", "lon")}) <= 150 AS agree,
    any_value(new_lat) AS spot_lat, any_value(new_lon) AS spot_lon, any_value(new_archive) AS spot_archive
  FROM (SELECT {keys}, lat, lon,
      first_value(lat) OVER w AS old_lat, first_value(lon) OVER w AS old_lon,
      last_value(lat) OVER w AS new_lat, last_value(lon) OVER w AS new_lon,
      last_value(archive) OVER w AS new_archive
    FROM catalog WHERE {box("lat", "lon")}
    WINDOW w AS (PARTITION BY {keys} ORDER BY {order}
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  GROUP BY {keys}"""


PARTS["pair_spots"] = _spots("station_id, name_key")
PARTS["id_spots"] = _spots("station_id")
PARTS["cataloged"] = f"""
  SELECT * EXCLUDE (lat, lon, c_lat, c_lon, c_archive, c_method, measured),
    CASE WHEN measured OR c_lat IS NULL THEN lat ELSE c_lat END AS lat,
    CASE WHEN measured OR c_lat IS NULL THEN lon ELSE c_lon END AS lon,
    CASE WHEN measured THEN 'trip_endpoint_median' WHEN c_lat IS NOT NULL THEN c_method
      ELSE 'missing' END AS coordinate_source,
    CASE WHEN NOT measured AND c_lat IS NOT NULL THEN c_archive ELSE archive END AS coordinate_source_archive,
    (NOT measured AND c_lat IS NOT NULL) AS coordinate_inferred
  FROM (
    SELECT r.*, {box("r.lat", "r.lon")} AS measured,
      CASE WHEN p.agree IS NOT NULL THEN 'historical_station_lookup'
        ELSE 'historical_lookup_id_only' END AS c_method,
      CASE WHEN p.agree THEN p.spot_lat WHEN p.agree IS NULL AND schema = 'legacy' AND i.agree
        THEN i.spot_lat END AS c_lat,
      CASE WHEN p.agree THEN p.spot_lon WHEN p.agree IS NULL AND schema = 'legacy' AND i.agree
        THEN i.spot_lon END AS c_lon,
      CASE WHEN p.agree THEN p.spot_archive WHEN p.agree IS NULL AND schema = 'legacy' AND i.agree
        THEN i.spot_archive END AS c_archive
    FROM scattered r
    LEFT JOIN pair_spots p ON r.station_id IS NOT DISTINCT FROM p.station_id AND r.name_key = p.name_key
    LEFT JOIN id_spots i ON r.station_id IS NOT DISTINCT FROM i.station_id)"""
PARTS["arrivals"] = f"""
  SELECT archive, member, station_id, name_key, lat, lon, coordinate_source_archive FROM (
    SELECT *, row_number() OVER (PARTITION BY archive, member, station_id, name_key
      ORDER BY coordinate_count DESC, station_name, lat, lon, coordinate_source_archive) AS place
    FROM cataloged WHERE role = 'end' AND coordinate_count >= 3 AND {box("lat", "lon")}
      AND NOT coordinate_rejected) WHERE place = 1"""
_MOVED = "(r.role = 'start' AND a.archive IS NOT NULL)"
PARTS["enriched"] = f"""
  SELECT r.* EXCLUDE (lat, lon, coordinate_source, coordinate_source_archive),
    CASE WHEN {_MOVED} THEN a.lat ELSE r.lat END AS lat,
    CASE WHEN {_MOVED} THEN a.lon ELSE r.lon END AS lon,
    CASE WHEN {_MOVED} THEN 'same_file_arrival_median' ELSE r.coordinate_source END AS coordinate_source,
    CASE WHEN {_MOVED} THEN a.coordinate_source_archive ELSE r.coordinate_source_archive END
      AS coordinate_source_archive
  FROM cataloged r LEFT JOIN arrivals a ON r.archive = a.archive AND r.member = a.member
    AND r.station_id IS NOT DISTINCT FROM a.station_id AND r.name_key = a.name_key"""
PARTS["fallback"] = """
  SELECT station_id, name AS station_name, lat, lon FROM information_rows
  UNION ALL
  SELECT id, station_name, latitude, longitude FROM city_rows
  WHERE id NOT IN (SELECT station_id FROM information_rows)"""
PARTS["unique_feed"] = f"""
  SELECT {norm("station_name")} AS name_key, min(lat) AS feed_lat, min(lon) AS feed_lon
  FROM fallback GROUP BY 1 HAVING count(*) = 1"""
_CELL = accepts("o.coarse_lat", "o.coarse_lon", "o.coordinate_count", "u.feed_lat", "u.feed_lon")
_PLACED = f"""(u.name_key IS NOT NULL AND o.coarse_lat IS NOT NULL AND {_CELL} AND o.name_key NOT IN
      (SELECT name_key FROM enriched WHERE {box("lat", "lon")}))"""
PARTS["located"] = f"""
  SELECT * EXCLUDE (placed, feed_lat, feed_lon, lat, lon, coordinate_source,
      coordinate_source_archive, coordinate_inferred),
    CASE WHEN placed THEN feed_lat ELSE lat END AS lat,
    CASE WHEN placed THEN feed_lon ELSE lon END AS lon,
    CASE WHEN placed THEN 'current_feed_exact_name_within_coarse_cell' ELSE coordinate_source END
      AS coordinate_source,
    CASE WHEN placed THEN 'current_feed_snapshot' ELSE coordinate_source_archive END
      AS coordinate_source_archive,
    coordinate_inferred OR placed AS coordinate_inferred,
    CASE WHEN valid_endpoint_count = 0 OR first_at IS NULL THEN 'no_valid_trip_time'
      WHEN name_key = '' THEN 'missing_station_name'
      WHEN {placeholder("name_key")} THEN 'numeric_placeholder_name' END AS reason
  FROM (SELECT o.*, {_PLACED} AS placed, u.feed_lat, u.feed_lon
    FROM enriched o LEFT JOIN unique_feed u ON o.name_key = u.name_key)"""
PARTS["kept"] = "SELECT * EXCLUDE (reason) FROM located WHERE reason IS NULL"
PARTS["excluded"] = "SELECT * FROM located WHERE reason IS NOT NULL"
PARTS["spotted"] = f"""
  SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY {SUPPORT}) AS rn
  FROM kept WHERE {box("lat", "lon")}"""
_NEAREST = (
    "list_sort(list_transform(w.anchors, lambda a: struct_pack(d := "
    + hav("a.lat", "a.lon", "l.lat", "l.lon")
    + ", no := a.no)))[1]"
)
PARTS["walk"] = f"""
  SELECT name_key, rn, [struct_pack(no := 0, lat := lat, lon := lon)] AS anchors, 0 AS home
  FROM spotted WHERE rn = 1
  UNION ALL
  SELECT name_key, rn, CASE WHEN near.d <= 150 THEN anchors
      ELSE list_append(anchors, struct_pack(no := len(anchors)::INT, lat := lat, lon := lon)) END,
    CASE WHEN near.d <= 150 THEN near.no ELSE len(anchors)::INT END
  FROM (SELECT l.name_key, l.rn, l.lat, l.lon, w.anchors, {_NEAREST} AS near
    FROM walk w JOIN spotted l ON l.name_key = w.name_key AND l.rn = w.rn + 1)"""
PARTS["anchored"] = """
  SELECT name_key, arg_max(anchors, rn) AS anchors FROM walk GROUP BY name_key"""
PARTS["homed"] = """
  SELECT l.* EXCLUDE (rn), w.home FROM spotted l JOIN walk w ON l.name_key = w.name_key AND l.rn = w.rn"""
PARTS["loose"] = f"""
  SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY {FILE_ORDER}) AS rn
  FROM kept WHERE NOT {box("lat", "lon")}"""
PARTS["opening"] = """
  SELECT n.name_key, coalesce(a.anchors, []) AS anchors,
    coalesce(h.ids, []) AS ids, coalesce(h.aids, []) AS aids
  FROM (SELECT DISTINCT name_key FROM loose) n
  LEFT JOIN anchored a ON n.name_key = a.name_key
  LEFT JOIN (SELECT name_key, list(DISTINCT struct_pack(no := home, id := coalesce(station_id, '~'))) AS ids,
      list(DISTINCT struct_pack(no := home, ar := archive, id := coalesce(station_id, '~'))) AS aids
    FROM homed GROUP BY name_key) h ON n.name_key = h.name_key"""
_OK = accepts("l.coarse_lat", "l.coarse_lon", "l.coordinate_count", "a.lat", "a.lon")
PARTS["attach"] = f"""
  SELECT name_key, 0::BIGINT AS rn, anchors, ids, aids, false AS has_loose, NULL::INT AS home FROM opening
  UNION ALL
  SELECT name_key, rn, anchors,
    CASE WHEN home IS NULL THEN ids ELSE list_append(ids, struct_pack(no := home, id := id)) END,
    CASE WHEN home IS NULL THEN aids ELSE list_append(aids, struct_pack(no := home, ar := archive, id := id)) END,
    has_loose OR home IS NULL, home
  FROM (
    SELECT *, CASE WHEN len(current) = 1 THEN current[1].no WHEN len(matches) = 1 THEN matches[1].no
        WHEN len(matches) = 0 AND len(anchors) = 1 AND NOT has_loose AND len(fitting) = 1
        THEN 0 END AS home
    FROM (SELECT *, list_filter(matches, lambda a: list_contains(aids,
            struct_pack(no := a.no, ar := archive, id := id))) AS current
      FROM (SELECT *, list_filter(fitting, lambda a: list_contains(ids,
              struct_pack(no := a.no, id := id))) AS matches
        FROM (SELECT l.name_key, l.rn, l.archive, coalesce(l.station_id, '~') AS id, w.anchors,
            w.ids, w.aids, w.has_loose, list_filter(w.anchors, lambda a: {_OK}) AS fitting
          FROM attach w JOIN loose l ON l.name_key = w.name_key AND l.rn = w.rn + 1))))"""
PARTS["settled"] = """
  SELECT * FROM homed
  UNION ALL BY NAME
  SELECT l.* EXCLUDE (rn) REPLACE (l.coordinate_inferred OR t.home IS NOT NULL AS coordinate_inferred), t.home
  FROM loose l JOIN attach t ON l.name_key = t.name_key AND l.rn = t.rn"""
PARTS["sizes"] = """
  SELECT s.name_key, coalesce(max(len(a.anchors)), 0) AS anchors,
    coalesce(max(len(a.anchors)), 0) + max(CASE WHEN s.home IS NULL THEN 1 ELSE 0 END) AS clusters
  FROM settled s LEFT JOIN anchored a ON s.name_key = a.name_key GROUP BY s.name_key"""
PARTS["clusters"] = f"""
  SELECT *, {entity_key("name_key", "anchor_lat", "anchor_lon")} AS station_key FROM (
    SELECT s.* EXCLUDE (home), coalesce(s.home, z.anchors)::BIGINT AS cluster_no,
      a.anchors[s.home + 1].lat AS anchor_lat, a.anchors[s.home + 1].lon AS anchor_lon,
      (s.home IS NULL AND z.anchors > 0) AS ambiguous, z.clusters > 1 AS many_locations
    FROM settled s JOIN sizes z ON s.name_key = z.name_key
    LEFT JOIN anchored a ON s.name_key = a.name_key)"""
PARTS["by_name"] = f"""
  SELECT *, NULL::DOUBLE AS anchor_lat, NULL::DOUBLE AS anchor_lon, 0::BIGINT AS cluster_no,
    false AS ambiguous, false AS many_locations,
    {entity_key("name_key", "NULL", "NULL")} AS station_key FROM kept"""
PARTS["singles"] = entities_sql("clusters")
PARTS["alias_pairs"] = f"""
  SELECT * FROM (
    SELECT a.station_key AS station_key_a, b.station_key AS station_key_b,
      list_sort(list_intersect(a.ids, b.ids))[1] AS source_id,
      {hav("a.station_lat", "a.station_lon", "b.station_lat", "b.station_lon")} AS metres
    FROM singles a JOIN singles b ON a.station_type = b.station_type
    JOIN (SELECT station_key, min(struct_pack(n := name_key, c := cluster_no)) AS idx FROM clusters
      GROUP BY 1) i ON i.station_key = a.station_key
    JOIN (SELECT station_key, min(struct_pack(n := name_key, c := cluster_no)) AS idx FROM clusters
      GROUP BY 1) j ON j.station_key = b.station_key
    WHERE i.idx < j.idx AND list_has_any(a.ids, b.ids)) WHERE metres <= 35"""
PARTS["spot_order"] = """
  SELECT e.*, idx FROM singles e JOIN (
    SELECT station_key, min(struct_pack(n := name_key, c := cluster_no)) AS idx FROM clusters GROUP BY 1) i
  ON e.station_key = i.station_key"""
# Edges one after another: an edge joins two groups if every pair across them is near.
PARTS["merge_steps"] = """
  SELECT row_number() OVER (ORDER BY p.source_id, a.idx, b.idx) AS nth, p.source_id,
    p.station_key_a AS one, p.station_key_b AS two
  FROM alias_pairs p JOIN spot_order a ON a.station_key = p.station_key_a
  JOIN spot_order b ON b.station_key = p.station_key_b"""
PARTS["close_by"] = f"""
  SELECT list(struct_pack(one := a.station_key, two := b.station_key)) AS held
  FROM spot_order a JOIN spot_order b ON a.station_type = b.station_type AND a.idx < b.idx
  WHERE {hav("a.station_lat", "a.station_lon", "b.station_lat", "b.station_lon")} <= 35"""
PARTS["merge_walk"] = """
  SELECT 0::BIGINT AS nth, (SELECT map_from_entries(list(DISTINCT struct_pack(k := key, v := key)))
    FROM (SELECT unnest([one, two]) AS key FROM merge_steps)) AS group_of, []::BIGINT[] AS taken
  UNION ALL
  SELECT nth, CASE WHEN fits THEN map_from_entries(list_transform(map_entries(group_of),
      lambda x: struct_pack(k := x.key, v := CASE WHEN x.value = b THEN a ELSE x.value END))) ELSE group_of END,
    CASE WHEN fits THEN list_append(taken, nth) ELSE taken END
  FROM (SELECT *, a <> b AND len(list_filter(held, lambda p: (group_of[p.one] = a AND group_of[p.two] = b)
        OR (group_of[p.one] = b AND group_of[p.two] = a)))
      = len(list_filter(map_values(group_of), lambda v: v = a)) * len(list_filter(map_values(group_of), lambda v: v = b))
      AS fits
    FROM (SELECT s.nth, w.group_of, w.taken, held, group_of[s.one] AS a, group_of[s.two] AS b
      FROM merge_walk w JOIN merge_steps s ON s.nth = w.nth + 1 CROSS JOIN close_by))"""
PARTS["merge_end"] = "SELECT * FROM merge_walk ORDER BY nth DESC LIMIT 1"
PARTS["merge_groups"] = """
  SELECT entry.key AS station_key, entry.value AS joint
  FROM (SELECT unnest(map_entries(group_of)) AS entry FROM merge_end)"""
PARTS["merge_heads"] = """
  SELECT joint, arg_min(g.station_key, struct_pack(t := station_first_trip_at, k := g.station_key)) AS merged_station_key
  FROM merge_groups g JOIN singles e ON e.station_key = g.station_key GROUP BY joint HAVING count(*) > 1"""
PARTS["merges"] = """
  SELECT s.source_id, s.one AS station_key_a, a.station_name AS station_name_a, s.two AS station_key_b,
    b.station_name AS station_name_b, h.merged_station_key, 'shared_source_id_and_within_35m' AS reason
  FROM merge_steps s JOIN merge_end w ON list_contains(w.taken, s.nth)
  JOIN singles a ON a.station_key = s.one JOIN singles b ON b.station_key = s.two
  JOIN merge_groups g ON g.station_key = s.one JOIN merge_heads h ON h.joint = g.joint"""
PARTS["reach"] = """
  SELECT station_key_a AS node, station_key_a AS other FROM alias_pairs
  UNION SELECT station_key_b, station_key_b FROM alias_pairs
  UNION
  SELECT r.node, CASE WHEN p.station_key_a = r.other THEN p.station_key_b ELSE p.station_key_a END
  FROM reach r JOIN alias_pairs p ON r.other IN (p.station_key_a, p.station_key_b)"""
# What a merge changes: the rows of a joint group take key, name and anchor of its head.
PARTS["clustered"] = """
  SELECT c.* REPLACE (coalesce(h.station_key, c.station_key) AS station_key,
      CASE WHEN h.station_key IS NULL THEN c.anchor_lat ELSE h.anchor_lat END AS anchor_lat,
      CASE WHEN h.station_key IS NULL THEN c.anchor_lon ELSE h.anchor_lon END AS anchor_lon,
      c.ambiguous AND h.station_key IS NULL AS ambiguous, c.many_locations AND h.station_key IS NULL AS many_locations),
    h.station_key IS NOT NULL AS merged, coalesce(h.name_key, c.name_key) AS key_name
  FROM clusters c LEFT JOIN merge_groups g ON g.station_key = c.station_key
  LEFT JOIN merge_heads m ON m.joint = g.joint LEFT JOIN singles h ON h.station_key = m.merged_station_key"""
PARTS["entities"] = entities_sql("clustered", merged=True)
PARTS["old_entities"] = entities_sql("by_name")
PARTS["review"] = f"""
  SELECT source_id, station_key_a, station_name_a, first_trip_at_a, station_key_b, station_name_b,
    first_trip_at_b, round(gap, 1) AS distance_meters,
    CASE WHEN gap IS NULL THEN 'shared_id_location_unknown'
      WHEN gap <= 150 THEN 'possible_rename_or_rack_conversion'
      ELSE 'reused_id_or_relocation' END AS reason
  FROM (
    SELECT min(x.id) AS source_id, a.station_key AS station_key_a, a.station_name AS station_name_a,
      a.station_first_trip_at AS first_trip_at_a, b.station_key AS station_key_b,
      b.station_name AS station_name_b, b.station_first_trip_at AS first_trip_at_b,
      any_value({hav("a.station_lat", "a.station_lon", "b.station_lat", "b.station_lon")}) AS gap
    FROM (SELECT station_key, unnest(ids) AS id FROM entities) x
    JOIN (SELECT station_key, unnest(ids) AS id FROM entities) y ON x.id = y.id
    JOIN entities a ON a.station_key = x.station_key
    JOIN entities b ON b.station_key = y.station_key
    WHERE a.station_first_trip_at < b.station_first_trip_at
      OR (a.station_first_trip_at = b.station_first_trip_at AND a.station_key < b.station_key)
    GROUP BY a.station_key, a.station_name, a.station_first_trip_at, b.station_key, b.station_name,
      b.station_first_trip_at)"""
PARTS["flagged"] = """
  SELECT * REPLACE (CASE WHEN station_key IN (
        SELECT station_key_a FROM review WHERE reason = 'possible_rename_or_rack_conversion'
        UNION SELECT station_key_b FROM review WHERE reason = 'possible_rename_or_rack_conversion')
      THEN array_to_string(list_sort(list_filter(
        list_append(string_split(quality_flags, ' | '), 'possible_rename'), lambda f: f <> '')), ' | ')
      ELSE quality_flags END AS quality_flags)
  FROM entities"""
PARTS["feed_points"] = """
  SELECT 'city' AS source, id AS feed_station_id, coalesce(short_name, '') AS short_name, station_name,
    latitude AS lat, longitude AS lon, status, '' AS feed_station_type, CAST(total_docks AS INT) AS capacity
  FROM city_rows
  UNION ALL
  SELECT 'gbfs', i.station_id, coalesce(short_name, ''), name, lat, lon,
    CASE WHEN is_installed = 0 THEN 'not_installed'
      WHEN is_renting = 1 AND is_returning = 1 THEN 'renting_and_returning'
      ELSE 'service_restricted' END, station_type, CAST(capacity AS INT)
  FROM information_rows i LEFT JOIN status_rows s ON i.station_id = s.station_id"""
PARTS["feeds"] = f"""
  SELECT f.* EXCLUDE (lat, lon), lat AS station_lat, lon AS station_lon,
    coalesce(inside, false) AS in_city, {norm("station_name")} AS name_key,
    CASE WHEN contains(lower(station_name), 'public rack') THEN 'public_rack' ELSE 'station' END AS name_class
  FROM feed_points f LEFT JOIN ({inside_sql("feed_points")}) USING (lat, lon)"""
_EDIT = (
    "list_max(list_transform(keys, lambda n: 1 - levenshtein(n, f.name_key)::DOUBLE"
    " / greatest(length(n), length(f.name_key))))"
)
PARTS["pairs"] = f"""
  SELECT e.*, f.source, f.feed_station_id, f.station_name AS feed_name, f.short_name AS feed_short_name,
    e.station_type = f.name_class AS same_name_class, list_contains(keys, f.name_key) AS exact_name,
    f.short_name <> '' AND coalesce(list_contains(e.ids, f.short_name), false) AS shared_short_name,
    {hav("e.station_lat", "e.station_lon", "f.station_lat", "f.station_lon")} AS metres,
    {_EDIT} AS similarity
  FROM (SELECT *, list_distinct(list_transform(names, lambda n: {norm("n")})) AS keys FROM entities) e
  CROSS JOIN feeds f"""
PARTS["candidates"] = """
  SELECT *, CASE WHEN rank = 0 THEN 'name_and_short_name_within_150m' WHEN rank = 1 THEN 'name_within_150m'
      WHEN rank = 2 THEN 'short_name_within_35m' ELSE 'review_only' END AS match_method
  FROM (
    SELECT station_key, station_name AS reference_name,
      station_first_trip_at AS reference_first_trip_at, station_last_trip_at AS reference_last_trip_at,
      endpoint_count AS reference_endpoint_count, source, feed_station_id, feed_name, feed_short_name,
      round(metres, 1) AS distance_meters, round(similarity, 4) AS name_similarity, exact_name,
      shared_short_name, same_name_class,
      CASE WHEN NOT same_name_class OR metres IS NULL THEN 99
        WHEN exact_name AND metres <= 150 THEN CASE WHEN shared_short_name THEN 0 ELSE 1 END
        WHEN shared_short_name AND metres <= 35 THEN 2 ELSE 99 END AS rank
    FROM pairs WHERE exact_name OR shared_short_name
      OR (metres <= 150 AND (similarity >= 0.65 OR metres <= 35)))"""
PARTS["resolved"] = """
  SELECT c.*, (a.station_key IS NOT NULL) AS accepted FROM candidates c LEFT JOIN (
    SELECT source, station_key, feed_station_id FROM (
      SELECT *, count(*) OVER (PARTITION BY source, feed_station_id) AS claims FROM (
        SELECT *, count(*) OVER (PARTITION BY source, station_key) AS ties FROM (
          SELECT *, min(rank) OVER (PARTITION BY source, station_key) AS best
          FROM candidates WHERE rank < 99) WHERE rank = best)
      WHERE ties = 1) WHERE claims = 1) a
  ON c.source = a.source AND c.station_key = a.station_key AND c.feed_station_id = a.feed_station_id"""
PARTS["covered"] = """
  SELECT f.* EXCLUDE (name_key, name_class), r.station_key, e.station_type AS reference_station_type,
    e.station_first_trip_at, r.match_method,
    CASE WHEN r.station_key IS NOT NULL THEN 'matched' ELSE 'no_unambiguous_history_match' END AS coverage_status
  FROM feeds f
  LEFT JOIN (SELECT * FROM resolved WHERE accepted) r
    ON f.source = r.source AND f.feed_station_id = r.feed_station_id
  LEFT JOIN entities e ON r.station_key = e.station_key"""
PARTS["name_firsts"] = f"""
  SELECT station_key, station_first_trip_at, name, min(station_first_trip_at) OVER (PARTITION BY name) AS earliest
  FROM (SELECT DISTINCT station_key, station_first_trip_at, {norm("n")} AS name
    FROM (SELECT station_key, station_first_trip_at, unnest(names) AS n FROM entities))"""
PARTS["earlier"] = """
  SELECT station_key, min(earliest) AS earlier_same_name_trip_at FROM name_firsts
  GROUP BY station_key HAVING min(earliest) < min(station_first_trip_at)"""
_REVIEW = ["name_has_multiple_locations", "possible_rename", "fewer_than_10_endpoints"]
_REVIEW += ["location_inferred_from_current_feed", "first_archive_day"]
_REASONS = ", ".join(
    ["CASE WHEN w.earlier_same_name_trip_at IS NOT NULL THEN 'earlier_same_name_history' END"]
    + [f"CASE WHEN contains(e.quality_flags, '{f}') THEN '{f}' END" for f in _REVIEW]
)


def _link(source: str) -> str:
    return f"""LEFT JOIN (SELECT r.station_key, r.feed_station_id, f.station_name, f.status,
      f.feed_station_type, r.match_method, r.distance_meters
    FROM resolved r JOIN feeds f ON r.source = f.source AND r.feed_station_id = f.feed_station_id
    WHERE r.accepted AND r.source = '{source}') {source[0]} ON e.station_key = {source[0]}.station_key"""


PARTS["reconciled"] = f"""
  SELECT e.*, c.feed_station_id AS city_station_id, c.station_name AS city_station_name,
    c.status AS city_status, c.match_method AS city_match_method,
    c.distance_meters AS city_match_distance_meters,
    g.feed_station_id AS gbfs_station_id, g.station_name AS gbfs_station_name, g.status AS gbfs_status,
    g.match_method AS gbfs_match_method, g.distance_meters AS gbfs_match_distance_meters,
    g.feed_station_type AS gbfs_station_type,
    CASE WHEN c.station_key IS NOT NULL OR g.station_key IS NOT NULL THEN 'matched'
      WHEN e.station_key IN (SELECT station_key FROM resolved
        WHERE rank < 99 OR exact_name OR shared_short_name) THEN 'needs_review'
      ELSE 'no_confirmed_match' END AS current_feed_match_status,
    'unverified_first_trip_proxy' AS opening_date_status, w.earlier_same_name_trip_at,
    array_to_string(list_filter([{_REASONS}], lambda f: f IS NOT NULL), ' | ') AS service_date_review_reasons,
    '2026-09-15' AS feed_snapshot_date
  FROM flagged e {_link("city")} {_link("gbfs")}
  LEFT JOIN earlier w ON e.station_key = w.station_key"""
PARTS["public_rows"] = """
  SELECT * FROM reconciled WHERE coalesce(in_city, false) AND station_type <> 'operational'"""
PARTS["links"] = """
  SELECT o.station_key AS old_station_key, n.station_key AS new_station_key,
    o.valid_endpoint_count AS old_valid, n.valid_endpoint_count AS new_valid
  FROM by_name o JOIN clustered n ON o.archive = n.archive AND o.member = n.member AND o.role = n.role
    AND o.station_id IS NOT DISTINCT FROM n.station_id
    AND o.original_station_name IS NOT DISTINCT FROM n.original_station_name"""
PARTS["risks"] = """
  SELECT s.station_key, s.station_name, s.station_type, s.station_first_trip_at,
    s.current_feed_match_status, min(a.station_first_trip_at) AS earlier_unlocated_same_name
  FROM public_rows s JOIN reconciled a ON s.station_name = a.station_name AND a.station_lat IS NULL
    AND a.station_first_trip_at < s.station_first_trip_at GROUP BY ALL"""

_HEAVY = {
    "trips", "obs", "located", "spotted", "loose", "clusters", "singles", "clustered", "entities", "old_entities",
    "feeds", "candidates", "resolved", "reconciled", "review", "catalog", "alias_pairs",
    "merge_steps", "close_by", "merge_end",
}
_WORD = re.compile(r"[a-z_]+")


def needs(text: str) -> list[str]:
    """The parts a text refers to, directly or not, in dependency order."""
    found: set[str] = set()
    queue = [text]
    while queue:
        for word in set(_WORD.findall(queue.pop())) & PARTS.keys():
            if word not in found:
                found.add(word)
                queue.append(PARTS[word])
    return [name for name in PARTS if name in found]


def query(text: str) -> str:
    """A full statement: the needed parts, then ``text``."""
    parts = needs(text)
    if not parts:
        return text
    clauses = [
        f"{name} AS {'MATERIALIZED ' if name in _HEAVY else ''}({PARTS[name]})" for name in parts
    ]
    recursive = "RECURSIVE " if RECURSIVE & set(parts) else ""
    return f"WITH {recursive}" + ",\n".join(clauses) + "\n" + text
