"""Trip ends, their census by place and point, and the roll-up to one observation per file, id, name and role.

The census counts equal ends, so repeated points shrink before the first shuffle, and
it holds all that the roll-up and the profile of files need.  A roll-up of stored trips
needs no census: where a task meets most places once, nothing combines before the
shuffle, so ends move once, as few columns, and totals and quantiles follow in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placetrace.functions.geo import in_box, is_coarse
from placetrace.functions.text import normalize_name
from placetrace.functions.times import trip_state, valid_trip
from placetrace.operators.quantiles import grouped_quantiles, interpolated, of_sorted
from placetrace.params import DEFAULT, Rules
from placetrace.session import checkpoint, checkpoint_large

PLACE = ("station_id", "station_name", "role")
LINEAGE = ("archive", "member", "schema")
POINT = ("lat", "lon", "state")
CODE = ["code_a", "code_b"]
# Points of one place that a single task may sort.
LIGHT = 1 << 20
# Groups of places, by hash, in which places of more points are looked for.
BUCKETS = 1 << 16
# Quantiles of each axis: of coarse points and of fine ones.
SPOTS = {
    "coarse_lat": {"coarse_lat": 0.5},
    "coarse_lon": {"coarse_lon": 0.5},
    "fine_lat": {"lat": 0.5, "lat_p05": 0.05, "lat_p95": 0.95},
    "fine_lon": {"lon": 0.5, "lon_p05": 0.05, "lon_p95": 0.95},
}


def endpoints(trips: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Two rows per trip.  One scan feeds both ends through ``inline``."""

    def end(role: str, at: str):
        return F.struct(
            F.col(at).alias("event_at"),
            F.col(f"{role}_station_id").alias("station_id"),
            F.col(f"{role}_station_name").alias("station_name"),
            F.col(f"{role}_lat").alias("lat"),
            F.col(f"{role}_lon").alias("lon"),
            F.lit(role).alias("role"),
        )

    kept = [name for name in LINEAGE if name in trips.columns]
    valid = valid_trip(F.col("started_at"), F.col("ended_at")).alias("valid_trip")
    ends = trips.select(
        *kept, "trip_id", valid, F.inline(F.array(end("start", "started_at"), end("end", "ended_at")))
    )
    lat, lon = F.col("lat"), F.col("lon")
    return ends.withColumn("in_region", in_box(lat, lon, rules.box)).withColumn(
        "coarse", is_coarse(lat, lon, rules)
    )


def _ends(trips: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two rows per trip, with the state of the trip."""

    def end(role: str, at: str):
        return F.struct(
            F.col(f"{role}_station_id").alias("station_id"),
            F.col(f"{role}_station_name").alias("station_name"),
            F.lit(role).alias("role"),
            F.col(f"{role}_lat").alias("lat"),
            F.col(f"{role}_lon").alias("lon"),
            F.col(at).alias("event_at"),
        )

    state = trip_state(F.col("started_at"), F.col("ended_at")).alias("state")
    return trips.select(*by, "trip_id", state, F.inline(F.array(end("start", "started_at"), end("end", "ended_at"))))


def census(trips: DataFrame, by: Sequence[str] = LINEAGE) -> DataFrame:
    """Trip ends counted by place, point and state of their trip.

    ``n`` ends, how many of them have a time and a trip id, the least and the
    greatest time, and the id of the first trip.  Missing ids, names and
    coordinates are values of their own.
    """
    by = [name for name in by if name in trips.columns]
    ends = _ends(trips, by)
    first = F.min(F.when(F.col("trip_id").isNotNull(), F.struct("event_at", "trip_id")))
    # The minimum of a struct makes Spark sort by these keys, so those that tell rows apart come first.
    return ends.groupBy(*POINT[:2], *PLACE, POINT[2], *by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("event_at").alias("timed"),
        F.count("trip_id").alias("named"),
        F.min("event_at").alias("first_at"),
        F.max("event_at").alias("last_at"),
        first.alias("first"),
    )


def _place_code(keys: Sequence[str]):
    """128 bits that stand for the key columns, NULLs told apart."""
    blanks = F.concat(*[F.when(F.col(k).isNull(), "0").otherwise("1") for k in keys])
    return F.xxhash64(*keys, blanks).alias("code_a"), F.xxhash64(F.lit("place"), *keys, blanks).alias("code_b")


def _totals(keys: Sequence[str]):
    """Aggregates over the points of one place; its key columns are the same in all of them."""
    valid, fine, coarse = F.col("valid"), F.col("series") == "fine", F.col("series") == "coarse"

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("long"))

    return [
        *[F.first(k).alias(k) for k in keys],
        F.sum("n").alias("endpoint_count"),
        total(valid).alias("valid_endpoint_count"),
        F.min(F.when(valid, F.col("first_at"))).alias("first_at"),
        F.max(F.when(valid, F.col("last_at"))).alias("last_at"),
        F.min(F.when(valid, F.col("first"))).getField("trip_id").alias("first_trip_id"),
        total(fine).alias("coordinate_count"),
        total(coarse).alias("coarse_coordinate_count"),
    ]


def _light(points: DataFrame) -> DataFrame:
    """Quantiles of places whose points a task can sort: all windows in one shuffle by place, of numbers only."""
    group = Window.partitionBy(*CODE, "series")
    ranked = points.repartition(*CODE).withColumn("total", F.sum("n").over(group))
    for axis in ("lat", "lon"):
        upto = group.orderBy(axis).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = ranked.withColumn(f"{axis}_upto", F.sum("n").over(upto))
    picks = []
    for series, named in SPOTS.items():
        kind, axis = series.split("_")
        upto = F.col(f"{axis}_upto")
        for column, p in named.items():
            value = interpolated(F.col("series") == kind, F.col(axis), upto - F.col("n"), upto, F.col("total"), p)
            picks.append(value.alias(column))
    return ranked.groupBy(*CODE).agg(*picks)


def _heavy(points: DataFrame) -> DataFrame:
    """The same for places of any size: combined before the shuffle, ranks found in buckets of values."""
    axes = [F.struct(F.concat("series", F.lit(f"_{axis}")).alias("series"), F.col(axis).alias("value")) for axis in ("lat", "lon")]
    values = points.select(F.struct(*CODE).alias("place"), "n", F.inline(F.array(*axes)))
    return grouped_quantiles(values, "place", SPOTS, weight="n").select("place.*", "*").drop("place")


def _crowded(located: DataFrame, light: int) -> DataFrame | None:
    """Places with more than ``light`` rows, or None.

    Rows are counted by bucket of places first: few numbers move, and a bucket
    without so many rows has no such place.
    """
    bucket = F.pmod("code_a", F.lit(BUCKETS)).alias("bucket")
    full = checkpoint(located.groupBy(bucket).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > light))
    if full.isEmpty():
        return None
    asked = located.select(*CODE, bucket).join(full, "bucket", "left_semi")
    crowded = checkpoint(asked.groupBy(*CODE).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > light))
    return None if crowded.isEmpty() else crowded


def _series(rules: Rules) -> Column:
    """'coarse' or 'fine' for a point in the box of a ``valid`` end, else NULL."""
    lat, lon = F.col("lat"), F.col("lon")
    spot = F.col("valid") & in_box(lat, lon, rules.box)
    return F.when(spot, F.when(is_coarse(lat, lon, rules), "coarse").otherwise("fine")).alias("series")


def _valid() -> Column:
    return F.col("state").isin("zero", "forward").alias("valid")


def _combined(points: DataFrame, keys: Sequence[str], rows: int, light: int, counted: bool) -> DataFrame:
    """Totals and quantiles by place, each combined before its shuffle; equal points too unless they are ``counted``."""
    totals = points.groupBy(*CODE).agg(*_totals(keys))
    located = points.filter("series IS NOT NULL").select(*CODE, "series", "lat", "lon", "n")
    # A place cannot have more points than there are.
    crowded = _crowded(located, light) if rows > light else None
    if not counted:
        located = located.groupBy(*CODE, "series", "lat", "lon").agg(F.sum("n").alias("n"))
    if crowded is None:
        spots = _light(located)
    else:
        few = located.join(crowded, CODE, "left_anti")
        many = located.join(crowded, CODE, "left_semi")
        spots = _light(few).unionByName(_heavy(many))
    return totals.join(spots, CODE, "left").drop(*CODE)


def _dealt(ends: DataFrame, keys: Sequence[str], rules: Rules) -> DataFrame:
    """The same for places whose ends a task can hold: ends move once, by place, and are sorted by it once.

    Codes are made on both sides of the shuffle: they are random and would be a third of it.
    """
    moved = ends.repartition(*_place_code(keys))
    points = moved.select("*", *_place_code(keys), _series(rules), *_alone(F.col("event_at")))
    totals, lists = _totals(keys), []
    for series in SPOTS:
        kind, axis = series.split("_")
        lists.append(F.collect_list(F.when(F.col("series") == kind, F.col(axis))).alias(f"__{series}"))
    found = points.groupBy(*CODE).agg(*totals, *lists).drop(*CODE)
    found = found.withColumns({f"__{series}": F.sort_array(f"__{series}") for series in SPOTS})
    picks = {column: of_sorted(F.col(f"__{series}"), p) for series, named in SPOTS.items() for column, p in named.items()}
    return found.withColumns(picks).drop(*[f"__{series}" for series in SPOTS])


def _alone(at: Column) -> list[Column]:
    """What a census says of a single end."""
    return [
        F.lit(1).cast("long").alias("n"),
        at.alias("first_at"),
        at.alias("last_at"),
        F.when(F.col("trip_id").isNotNull(), F.struct("event_at", "trip_id")).alias("first"),
    ]


def _named(found: DataFrame) -> DataFrame:
    return found.withColumn("name_key", normalize_name(F.col("station_name")))


def _keys(df: DataFrame) -> list[str]:
    return [*[name for name in LINEAGE if name in df.columns], *PLACE]


def observe_census(counted: DataFrame, rules: Rules = DEFAULT, light: int = LIGHT) -> DataFrame:
    """The observations of a stored census."""
    keys = _keys(counted)
    points = counted.select("*", _valid(), *_place_code(keys)).select("*", _series(rules))
    return _named(_combined(points, keys, counted.count(), light, counted=True))


def observe(trips: DataFrame, by: Sequence[str] = LINEAGE, rules: Rules = DEFAULT) -> DataFrame:
    """One row per file, station id, station name and role.

    Only valid trips count for times and coordinates.  Missing ids and names
    stay as groups of their own, so that every endpoint is accounted for.
    """
    return observe_census(checkpoint_large(census(trips, by)), rules)


def single_ends(trips: DataFrame, by: Sequence[str] = LINEAGE) -> DataFrame:
    """The ends of trips as rows of a census that counts each for itself: nothing is shuffled."""
    ends = _ends(trips, [name for name in by if name in trips.columns])
    timed, named = (F.col(name).isNotNull().cast("long") for name in ("event_at", "trip_id"))
    return ends.select("*", *_alone(F.col("event_at")), timed.alias("timed"), named.alias("named"))


def observe_stored(
    trips: DataFrame, by: Sequence[str] = LINEAGE, rules: Rules = DEFAULT, light: int = LIGHT
) -> DataFrame:
    """The same for stored trips, without a census.

    Places with more than ``light`` ends are combined before they move, the others move as they are.
    """
    ends = _ends(trips, [name for name in by if name in trips.columns])
    keys = _keys(ends)
    plain = ends.select(*keys, "lat", "lon", "event_at", "trip_id", _valid())
    rows = 2 * trips.count()
    coded = plain.select("*", *_place_code(keys))
    crowded = _crowded(coded, light) if rows > light else None
    if crowded is None:
        return _named(_dealt(plain, keys, rules))
    few = coded.join(crowded, CODE, "left_anti").drop(*CODE)
    many = coded.join(crowded, CODE, "left_semi").select("*", _series(rules), *_alone(F.col("event_at")))
    return _named(_dealt(few, keys, rules).unionByName(_combined(many, keys, rows, light, counted=False)))
