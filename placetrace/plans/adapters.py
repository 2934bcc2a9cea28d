"""Trips, catalogs and feeds derived from the star-schema check tables.

The tables know orders and parts, not places.  A key ``k`` (customer, supplier
or part) names a place: 180 keys form a zone with 45 names on 15 sites, three
names per site some 22 m apart; ids are shared between names; some places have
a second location.  The number of zones grows with the tables.  The part key
``pk`` decides which value is missing, rounded or spelled differently.

The expressions are SQL that Spark and the checking engine read alike, so both
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrace.sources.boundary import edges_from_rings

# Every adapter is a chain of projections, each over the one before.  Short
# expressions keep the generated code small enough to be compiled well.


def _zone(k: str) -> str:
    return f"CAST(({k} - {k} % 180) / 180 AS BIGINT)"


def _place(k: str, z: str, end: str = "") -> dict[str, str]:
    """What a key says about its place: id, name, coordinates."""
    number = f"CAST({k} % 45 + 45 * {z} AS STRING)"
    return {
        f"{end}id": f"CASE WHEN {k} % 60 < 10 THEN 'U' || CAST({k} AS STRING)"
        f" ELSE CAST({k} % 60 + 60 * {z} AS STRING) END",
        f"{end}name": f"CASE WHEN {k} % 45 = 44 THEN 'Repair Depot ' || {number}"
        f" WHEN {k} % 45 = 3 THEN 'Public Rack - Stop ' || {number} ELSE 'Stop ' || {number} END",
        f"{end}lat": f"416E-1 + ({k} % 15) * 1E-2 + (({k} % 45 - {k} % 15) / 15) * 2E-4"
        f" + CASE WHEN {k} % 45 < 5 AND {k} % 4 = 0 THEN 5E-2 ELSE 0E0 END"
        f" + ((({z} - {z} % 45) / 45) % 3) * 2E-1 + ((({z} - {z} % 135) / 135) % 4) * 25E-4",
        f"{end}lon": f"-879E-1 + (({k} % 15 + {z}) % 45) * 1E-2",
    }


def _place_rows(key: str, k: str, end: str) -> tuple[dict[str, str], ...]:
    """Place columns of a key table, with the spellings a trip end may report."""
    base = {"key": "key", "k": "k", "id": "id", "name": "name", "lat": "lat", "lon": "lon"}
    return (
        {"key": key, "k": k},
        {"key": "key", "k": "k", "z": _zone("k")},
        {"key": "key", "k": "k"} | _place("k", "z"),
        base
        | {
            "temp": "upper(name) || ' (Temp)'",
            "digits": "CAST(k % 60 AS STRING)",
            "lat2": "round(lat, 2)",
            "lon2": "round(lon, 2)",
            "rough": "k % 45 = 20",
        },
        {
            f"{end}key": "key",
            f"{end}id": "id",
            f"{end}name": "name",
            f"{end}star": "name || ' (*)'",
            f"{end}temp": "temp",
            f"{end}digits": "digits",
            f"{end}lat": "CASE WHEN rough THEN lat2 ELSE lat END",
            f"{end}lon": "CASE WHEN rough THEN lon2 ELSE lon END",
            f"{end}lat2": "lat2",
            f"{end}lon2": "lon2",
            f"{end}step": "CASE WHEN rough THEN 0E0 ELSE 1E-5 END",
        },
    )


START_PLACES = _place_rows("c_custkey", "CAST((c_custkey - c_custkey % 4) / 4 AS BIGINT)", "a_")
END_PLACES = _place_rows("s_suppkey", "s_suppkey", "b_")


def _blur(end: str) -> dict[str, str]:
    """What a trip end reports of its place, depending on the part key."""
    coordinates = {
        axis: f"CASE WHEN unknown THEN NULL WHEN pk % 37 = 0 THEN 0E0"
        f" WHEN pk % 11 = 0 THEN {end}{axis}2 ELSE {end}{axis} + (pk % {step}) * {end}step END"
        for axis, step in (("lat", 7), ("lon", 5))
    }
    return {
        "station_id": f"CASE WHEN pk % 13 = 0 THEN NULL ELSE {end}id END",
        "station_name": f"CASE WHEN pk % 17 = 0 THEN NULL WHEN pk % 53 = 0 THEN {end}digits"
        f" WHEN pk % 23 = 0 THEN {end}star WHEN pk % 29 = 0 THEN {end}temp ELSE {end}name END",
        **coordinates,
    }


def _ends() -> dict[str, str]:
    out = {}
    for role, end in (("start", "a_"), ("end", "b_")):
        out |= {f"{role}_{name}": text for name, text in _blur(end).items()}
    return out


TRIPS = (
    {
        "k1": "o_custkey",
        "k2": "l_suppkey",
        "pk": "l_partkey",
        "y": "year(o_orderdate)",
        "unknown": "l_partkey % 41 = 0 OR year(o_orderdate) <= 1993",
        "trip_id": "CASE WHEN l_partkey % 101 = 0 THEN NULL ELSE"
        " CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) END",
        "started_at": "o_orderdate",
        "ended_at": "l_shipdate",
    },
    {
        "archive": "CAST(y AS STRING)",
        "member": "'trips_' || CAST(y AS STRING) || '.csv'",
        "schema": "CASE WHEN y <= 1993 THEN 'legacy' ELSE 'modern' END",
        "trip_id": "trip_id",
        "started_at": "started_at",
        "ended_at": "ended_at",
    }
    | _ends(),
)

# Three catalog snapshots per place; some disagree about where it is.
CATALOG = (
    {"c": "c_custkey", "k": "CAST((c_custkey - c_custkey % 3) / 3 AS BIGINT)"},
    {"c": "c", "k": "k", "z": _zone("k")},
    {"c": "c", "k": "k"} | _place("k", "z"),
    {
        "station_id": "id",
        "station_name": "name",
        "lat": "CASE WHEN k % 45 = 20 THEN NULL ELSE lat END + (c % 3) * (CASE WHEN k % 25 = 0 THEN 1E-2 ELSE 2E-4 END)",
        "lon": "lon",
        "reported_online_at": "CASE WHEN c % 8 = 0 THEN NULL ELSE"
        " CAST(CAST('2013-06-01' AS DATE) + CAST(c % 400 AS INT) AS {ntz}) END",
        "reported_created_at": "CAST(NULL AS {ntz})",
        "archive": "'catalog_' || CAST(2013 + c % 3 AS STRING)",
        "member": "'stations.csv'",
    },
)

CITY = (
    {"k": "s_suppkey", "z": _zone("s_suppkey"), "money": "s_acctbal", "nation": "s_nationkey"},
    {"k": "k", "money": "money", "nation": "nation"} | _place("k", "z"),
    {
        "id": "'C' || CAST(k AS STRING)",
        "station_name": "name || CASE WHEN k % 10 = 9 THEN ' East' ELSE '' END",
        "short_name": "id",
        "total_docks": "CAST(10 + k % 20 AS STRING)",
        "docks_in_service": "CAST(8 + k % 20 AS STRING)",
        "status": "CASE WHEN money < 0 THEN 'Not In Service' ELSE 'In Service' END",
        "latitude": "lat + 1E-4",
        "longitude": "lon",
        "region_id": "CASE WHEN nation = 3 THEN '' WHEN nation = 4 THEN NULL"
        " ELSE CAST(nation AS STRING) END",
    },
)

# Operator rows: the first quarter of a zone carries the plain names.
INFORMATION = (
    {"k": "p_partkey", "z": _zone("p_partkey"), "size": "p_size"},
    {"k": "k", "size": "size"} | _place("k", "z"),
    {
        "station_id": "'P' || CAST(k AS STRING)",
        "name": "name || CASE WHEN k % 180 < 45 THEN '' ELSE ' Annex '"
        " || CAST(k % 180 AS STRING) END",
        "short_name": "id",
        "lat": "lat + 5E-5",
        "lon": "lon",
        "station_type": "CASE WHEN size % 2 = 0 THEN 'classic' ELSE 'lightweight' END",
        "capacity": "size",
    },
)

STATUS = (
    {
        "station_id": "'P' || CAST(p_partkey AS STRING)",
        "is_installed": "CASE WHEN p_partkey % 20 = 7 THEN 0 ELSE 1 END",
        "is_renting": "CASE WHEN p_partkey % 9 = 4 THEN 0 ELSE 1 END",
        "is_returning": "CASE WHEN p_partkey % 14 = 5 THEN 0 ELSE 1 END",
    },
)

# A boundary: a square with a hole, and a triangle; rings as (polygon, ring, x, y).
BOUNDARY_RINGS = (
    ("square", 0, ((-87.905, 41.595), (-87.5, 41.595), (-87.5, 42.0), (-87.905, 42.0))),
    ("square", 1, ((-87.8, 41.66), (-87.76, 41.66), (-87.76, 41.7), (-87.8, 41.7))),
    ("triangle", 0, ((-87.905, 42.02), (-87.4, 42.02), (-87.6, 42.25))),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chain(df: DataFrame, steps: tuple[dict[str, str], ...]) -> DataFrame:
    for step in steps:
        df = df.selectExpr(
            *[f"{text.replace('{ntz}', 'TIMESTAMP_NTZ')} AS {name}" for name, text in step.items()]
        )
    return df


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trips from the customer's place to the supplier's.

    The two big tables are merged on their key at any scale, so that the work
    after the join is spread even when a table comes as one small file.  Customers
    meet the orders before that, and only keys take part in the joins: places are
    made of them afterwards, so that wide rows are neither shuffled nor broadcast.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    starts = table(spark, sf_dir, "customer").select("c_custkey")
    ends = table(spark, sf_dir, "supplier").select("s_suppkey")
    ordered = orders.join(starts, F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.hint("merge").join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(ends, F.col("l_suppkey") == F.col("s_suppkey"))
    keys = {"c_custkey": "c_custkey", "s_suppkey": "s_suppkey"}
    placed = _chain(joined, (TRIPS[0] | keys,))
    for key, steps in (("c_custkey", START_PLACES), ("s_suppkey", END_PLACES)):
        kept = {name: name for name in placed.columns if name != key}
        placed = _chain(placed, tuple(kept | step for step in steps))
    return _chain(placed, TRIPS[1:])


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(table(spark, sf_dir, "customer"), CATALOG)


def city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(table(spark, sf_dir, "supplier"), CITY)


def information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(table(spark, sf_dir, "part"), INFORMATION)


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(table(spark, sf_dir, "part"), STATUS)


def boundary(spark: SparkSession) -> DataFrame:
    rows = [
        (polygon, ring, place, x, y)
        for polygon, ring, points in BOUNDARY_RINGS
        for place, (x, y) in enumerate(points)
    ]
    schema = "polygon string, ring int, place int, x double, y double"
    return edges_from_rings(spark.createDataFrame(rows, schema))


def sql(steps: tuple[dict[str, str], ...], source: str) -> str:
    """The same chain for the checking engine."""
    for step in steps:
        chosen = ", ".join(f"{text} AS {name}" for name, text in step.items())
        source = f"(SELECT {chosen.replace('{ntz}', 'TIMESTAMP')} FROM {source})"
    return source


def trips_sql() -> str:
    joined = sql(TRIPS[:1], "lineitem JOIN orders ON l_orderkey = o_orderkey")
    placed = (
        f"{joined} JOIN {sql(START_PLACES, 'customer')} ON k1 = a_key"
        f" JOIN {sql(END_PLACES, 'supplier')} ON k2 = b_key"
    )
    return sql(TRIPS[1:], placed)
