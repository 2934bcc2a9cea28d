"""Queries over files that Spark writes from the check tables: sources, sinks, manifests, refreshes.

Every query writes under a folder of its own in the checkpoint folder and reads
it back through the library, so files, copies, codecs and headers are real.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.operators import matching, normalize, profile
from placetrace.operators.members import compare_manifest
from placetrace.operators.observe import census
from placetrace.plans.registry import ORACLE, register
from placetrace.plans.stages import Stages
from placetrace.session import checkpoint, checkpoint_folder
from placetrace.sources import feeds, integrity, tables, text_tables
from placetrace.streaming import incremental


def folder(s: Stages) -> str:
    return f"{checkpoint_folder(s.spark)}/files-{uuid.uuid4().hex}"


def write_parts(rows: DataFrame, part: str, path: str, **options) -> None:
    """One file for each value of ``part``, with its rows in a fixed order, so that equal rows give equal bytes."""
    columns = [c for c in rows.columns if c != part]
    (
        rows.repartition(part)
        .sortWithinPartitions(part, *[f"`{c}`" for c in columns])
        .write.options(header=True, quote='"', escape='"', **options)
        .partitionBy(part)
        .csv(path)
    )


def legacy(s: Stages) -> DataFrame:
    """Events as legacy trips, by event type."""
    from placetrace.plans.queries import text_tables as made

    rows = made(s)[1]
    return rows.withColumn("part", F.col("to_station_id"))


def write_archive(s: Stages, root: str) -> None:
    """Three header families, plain and compressed, and copies of one of them under later names."""
    from placetrace.plans.queries import text_tables as made

    modern, _, verbose = made(s)
    line = F.substring_index("ride_id", "-", -1)
    write_parts(modern.withColumn("part", line), "part", f"{root}/a_modern", compression="gzip")
    write_parts(legacy(s), "part", f"{root}/b_legacy")
    write_parts(verbose.withColumn("part", F.col("`03 - Rental Start Station ID`")), "part", f"{root}/c_verbose", compression="bzip2")
    write_parts(legacy(s), "part", f"{root}/d_copies")


@register("archive_read", ORACLE["schema_unify"])
def _(s: Stages) -> DataFrame:
    root = folder(s)
    write_archive(s, root)
    trips, _ = text_tables.read_archive(s.spark, root)
    return trips.drop("archive", "member")


@register(
    "archive_files",
    """SELECT 'modern' AS kind, 11::BIGINT AS headers, false AS is_copy, count(*) AS rows, count(*) FILTER (WHERE l_shipdate < o_orderdate) AS reversed_trips
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_linenumber
    UNION ALL SELECT 'legacy', 7, false, count(*), 0 FROM events GROUP BY event_type
    UNION ALL SELECT 'legacy', 7, true, NULL, NULL FROM events GROUP BY event_type
    UNION ALL SELECT 'legacy', 7, false, count(*), 0 FROM orders GROUP BY o_orderstatus""",
)
def _(s: Stages) -> DataFrame:
    root = folder(s)
    write_archive(s, root)
    listed = integrity.manifest(s.spark, root)
    trips, _ = text_tables.read_archive(s.spark, root, listed=listed)
    trips = checkpoint(trips)
    profiles = profile.profile_trips(trips, ends=checkpoint(census(trips)))
    files = listed.join(profiles, ["archive", "member"], "left")
    return files.select(
        "kind", F.size("headers").cast("long").alias("headers"), F.col("duplicate_of").isNotNull().alias("is_copy"), "rows", "reversed_trips"
    )


@register(
    "header_signatures",
    """SELECT count(DISTINCT family) AS header_signatures FROM (SELECT 'modern' AS family FROM lineitem
      UNION ALL SELECT 'legacy' FROM events UNION ALL SELECT 'verbose' FROM orders)""",
)
def _(s: Stages) -> DataFrame:
    root = folder(s)
    write_archive(s, root)
    return profile.header_signatures(integrity.manifest(s.spark, root))


@register(
    "file_integrity",
    """SELECT status, count(*) AS files FROM (SELECT CASE WHEN event_type = 'click' THEN 'wrong_sha256' ELSE 'ok' END AS status
      FROM events GROUP BY event_type) GROUP BY status""",
)
def _(s: Stages) -> DataFrame:
    """Files hashed in blocks against what Spark makes of their whole content; one pin is wrong."""
    root = folder(s)
    write_parts(legacy(s), "part", root)
    found = integrity.fingerprints(s.spark, root).filter("key LIKE '%.csv'")
    whole = s.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(root)
    steps = F.split("path", "/")
    pins = whole.select(
        F.concat_ws("/", F.element_at(steps, -2), F.element_at(steps, -1)).alias("key"),
        F.col("length").alias("size"),
        F.md5("content").alias("etag"),
        F.when(F.element_at(steps, -2) == "part=click", F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2("content", 256)).alias("sha256"),
    )
    return compare_manifest(found, pins).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@register(
    "incremental_rollup",
    """SELECT station_id, station_name, role, count(*) AS endpoint_count, count(*) FILTER (WHERE fine) AS valid_endpoint_count,
      min(moment) FILTER (WHERE fine) AS first_at, max(moment) FILTER (WHERE fine) AS last_at FROM (
      SELECT user_id::VARCHAR AS station_id, 'User ' || user_id AS station_name, 'start' AS role, date_trunc('minute', ts) AS moment,
        event_type <> 'error' AS fine FROM events
      UNION ALL SELECT event_type, NULL, 'end', date_trunc('second', ts), event_type <> 'error' FROM events) GROUP BY ALL""",
)
def _(s: Stages) -> DataFrame:
    """Three refreshes: half of the files, all of them, and again with a copy of every file."""
    root, out = folder(s), folder(s)
    rows = legacy(s)
    early = F.col("part").isin("click", "view")
    write_parts(rows.filter(early), "part", f"{root}/first")
    incremental.refresh(s.spark, root, out)
    write_parts(rows.filter(~early), "part", f"{root}/second")
    incremental.refresh(s.spark, root, out)
    write_parts(rows, "part", f"{root}/third")
    incremental.refresh(s.spark, root, out)
    seen = incremental.current_observations(s.spark, out, root)
    return seen.groupBy("station_id", "station_name", "role").agg(
        F.sum("endpoint_count").alias("endpoint_count"),
        F.sum("valid_endpoint_count").alias("valid_endpoint_count"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )


@register(
    "observations_reload",
    """SELECT archive, count(*) AS rows, sum(endpoint_count)::BIGINT AS endpoints, min(first_at) AS first_at,
      count(DISTINCT station_id) AS ids FROM obs WHERE archive <> '1995' GROUP BY archive""",
)
def _(s: Stages) -> DataFrame:
    path = folder(s)
    observations = s.observations()
    tables.write_observations(observations, path)
    skip = observations.filter("archive = '1995'").select("archive", "member").distinct()
    again = tables.read_observations(s.spark, path, observations.schema, skip)
    return again.groupBy("archive").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("endpoint_count").alias("endpoints"),
        F.min("first_at").alias("first_at"),
        F.countDistinct("station_id").alias("ids"),
    )


_FIELDS = "station_key string, station_id string, station_name string, station_first_trip_at timestamp_ntz, in_city boolean, endpoint_count long"


@register(
    "published_reload",
    "SELECT station_key, station_id, station_name, station_first_trip_at, in_city, endpoint_count FROM public_rows",
)
def _(s: Stages) -> DataFrame:
    """Public rows through a typed text file: ids stay text, blanks are NULL."""
    path = folder(s)
    tables.write_csv(s.public(), path, [f.split()[0] for f in _FIELDS.split(", ")])
    return tables.read_csv(s.spark, path, _FIELDS)


@register("published_tables", "SELECT station_type, count(*) AS rows, min(station_first_trip_at) AS first FROM public_rows GROUP BY 1")
def _(s: Stages) -> DataFrame:
    tables.publish({"published_places": s.public()})
    return s.spark.sql("SELECT station_type, count(*) AS rows, min(station_first_trip_at) AS first FROM published_places GROUP BY 1")


@register(
    "feed_files",
    """SELECT station_id, name, short_name, round(lat, 8) AS lat, round(lon, 8) AS lon, station_type,
      CAST(capacity AS INT) AS capacity FROM information_rows""",
)
def _(s: Stages) -> DataFrame:
    """The operator feed as pages of nested JSON."""
    path = folder(s)
    rows = s.information().select(
        "station_id", "name", "short_name", "lat", "lon", "station_type", F.col("capacity").cast("int").alias("capacity")
    )
    page = F.pmod(F.xxhash64("station_id"), F.lit(64))
    stations = F.struct(F.collect_list(F.struct(*rows.columns)).alias("stations")).alias("data")
    pages = rows.groupBy(page.alias("page")).agg(F.to_json(F.struct(stations)).alias("body"))
    pages.write.partitionBy("page").text(path)
    again = feeds.read_stations(s.spark, path, feeds.INFORMATION)
    return again.withColumns({name: F.round(name, 8) for name in ("lat", "lon")})


@register(
    "catalog_text",
    """SELECT s_suppkey::VARCHAR AS station_id, 'Stop ' || s_suppkey AS station_name,
      CASE WHEN s_suppkey % 5 <> 0 THEN (40 + s_suppkey % 3)::DOUBLE END AS lat, -87.5::DOUBLE AS lon,
      CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '2013-06-01 00:00:00' END AS reported_online_at FROM supplier""",
)
def _(s: Stages) -> DataFrame:
    """A station catalog as text: blanks, a bad number, dates on some rows."""
    key = F.col("s_suppkey")
    text = s.table("supplier").select(
        key.cast("string").alias("id"),
        F.concat(F.lit(" Stop  "), key).alias("name"),
        F.when(key % 5 == 0, "none").otherwise((key % 3 + 40).cast("string")).alias("latitude"),
        F.lit("-87.5").alias("longitude"),
        F.when(key % 2 == 0, "6/1/2013").otherwise("").alias("online date"),
        F.lit("2013").alias("archive"),
        F.lit("stations.csv").alias("member"),
    )
    found = normalize.normalize_catalog(text)
    return found.select("station_id", "station_name", "lat", "lon", "reported_online_at")


@register(
    "inventory_fields",
    """SELECT c.id AS "City ID", c.station_name, '{"id":"' || c.id || '","status":"' || c.status || '"}' AS place, NULL::VARCHAR AS ward,
      (r.station_key IS NOT NULL) AS reference_matched, r.station_key FROM city_rows c LEFT JOIN public_rows r ON c.id = r.city_station_id""",
)
def _(s: Stages) -> DataFrame:
    """Renamed headers, a nested cell as JSON text, and a field that the feed does not have."""
    city = s.city().withColumn("where", F.struct("id", "status"))
    names = {"id": "City ID", "station_name": "station_name", "where": "place", "ward": "ward"}
    joined = matching.enrich_inventory(city, s.public(), names)
    return joined.select("City ID", "station_name", "place", "ward", "reference_matched", "station_key")
