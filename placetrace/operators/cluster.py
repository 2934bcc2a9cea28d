"""Fixed-anchor clusters inside each name, without a pass over the name in order.

The rule is sequential: located rows are taken best supported first; a row joins
the nearest anchor within reach or becomes an anchor itself; rows without a
location are then attached one after the other.  Read as a whole it says

* anchors are the greedy independent set in that order, and a row belongs to the
  nearest *earlier* anchor - found by rounds over small cells, in which each
  cell has at most one anchor, so a name of any size is spread over many tasks;
* the fate of an unlocated row depends on earlier rows only through minima of
  positions per name, per (name, id) and per (name, archive, id).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placetrace.functions.geo import METRES_PER_DEGREE, cell, coarse_cell_contains, haversine, in_box
from placetrace.operators.joins import join_null_safe
from placetrace.params import DEFAULT, Rules
from placetrace.session import checkpoint

CELL = ["name_key", "cy", "cx"]


def entity_key(name_key: Column, lat: Column, lon: Column, rules: Rules = DEFAULT) -> Column:
    """Reproducible key of a name and its anchor; coordinates as fixed-scale text."""

    def text(value: Column) -> Column:
        return F.coalesce(value.cast("decimal(12,8)").cast("string"), F.lit("none"))

    digest = F.sha2(F.concat_ws("|", name_key, text(lat), text(lon)), 256)
    return F.concat(F.lit(rules.key_prefix), F.substring(digest, 1, 16))


def support_order() -> Column:
    """Best supported rows first; ends with a full key, so no two rows tie."""
    return F.struct(
        (-F.col("valid_endpoint_count")).alias("support"),
        (F.col("role") != "end").alias("departure"),
        F.col("first_at"),
        F.col("archive"),
        F.coalesce("station_id", F.lit("")).alias("id"),
        F.col("member"),
        F.coalesce("station_name", F.lit("")).alias("name"),
        F.coalesce("original_station_name", F.lit("")).alias("original"),
        F.col("lat"),
        F.col("lon"),
    )


def file_order() -> Column:
    return F.struct(
        F.col("archive"),
        F.col("member"),
        F.coalesce("station_id", F.lit("")).alias("id"),
        F.col("role"),
        F.coalesce("station_name", F.lit("")).alias("name"),
        F.coalesce("original_station_name", F.lit("")).alias("original"),
    )


class Grid:
    """Cells so small that any two points of one cell are within ``metres``."""

    def __init__(self, metres: float, rules: Rules):
        lats = (abs(rules.box.lat_min), abs(rules.box.lat_max))
        crosses = rules.box.lat_min <= 0 <= rules.box.lat_max
        widest = math.cos(math.radians(0 if crosses else min(lats)))
        if max(lats) > 89.0:
            raise ValueError("the region of the rules must end below 89 degrees of latitude")
        narrowest = math.cos(math.radians(max(lats)))
        side = metres * 0.999 / math.sqrt(2)
        self.lat_side = side / METRES_PER_DEGREE
        self.lon_side = self.lat_side / widest
        self.lat_reach = math.ceil(metres / side)
        self.lon_reach = math.ceil(metres / (side * narrowest / widest))

    def place(self, df: DataFrame) -> DataFrame:
        return df.withColumn("cy", cell(F.col("lat"), self.lat_side)).withColumn(
            "cx", cell(F.col("lon"), self.lon_side)
        )

    def spread(self, df: DataFrame) -> DataFrame:
        """Copies every row to the cells within reach."""

        def around(name: str, reach: int) -> Column:
            return F.explode(F.sequence(F.col(name) - reach, F.col(name) + reach))

        return df.withColumn("cy", around("cy", self.lat_reach)).withColumn(
            "cx", around("cx", self.lon_reach)
        )


def find_anchors(located: DataFrame, metres: float, grid: Grid) -> DataFrame:
    """The greedy independent set, as (name_key, lat, lon, ord, cy, cx).

    Per round the first undecided point of a cell is an anchor if it precedes
    the first ones of all cells in reach; points near a new anchor are decided.
    Rows copied to cells are merged, not broadcast: their file tells nothing of their number.
    The first point overall always qualifies, so the rounds end.  A round moves
    one row per cell, not pairs of points.
    """
    undecided = checkpoint(
        grid.place(
            located.groupBy("name_key", "lat", "lon").agg(F.min("ord").alias("ord"))
        )
    )
    anchors = None
    while not undecided.isEmpty():
        firsts = undecided.groupBy(*CELL).agg(F.min("ord").alias("ord"))
        around = grid.spread(firsts).groupBy(*CELL).agg(F.min("ord").alias("best"))
        found = checkpoint(
            firsts.join(around, CELL)
            .filter(F.col("ord") == F.col("best"))
            .select(*CELL, F.col("ord.lat").alias("lat"), F.col("ord.lon").alias("lon"), "ord")
        )
        anchors = found if anchors is None else anchors.unionByName(found)
        covers = (
            grid.spread(found)
            .groupBy(*CELL)
            .agg(F.collect_list(F.struct("lat", "lon")).alias("near"))
        )
        near = F.exists(
            "near",
            lambda a: haversine(F.col("lat"), F.col("lon"), a["lat"], a["lon"]) <= metres,
        )
        undecided = checkpoint(
            undecided.join(covers.hint("merge"), CELL, "left")
            .filter(F.col("near").isNull() | ~near)
            .drop("near")
        )
    if anchors is None:
        anchors = undecided.select(*CELL, "lat", "lon", "ord")
    return anchors


def number_anchors(anchors: DataFrame) -> DataFrame:
    """Adds ``cluster_no``: 0, 1, 2 ... in the order of a name.

    It stands for the order from here on, so rows carry a number and not the long key.
    A name has at most one anchor per cell of the box, so the windows are bounded.
    """
    place = F.row_number().over(Window.partitionBy("name_key").orderBy("ord"))
    return checkpoint(anchors.withColumn("cluster_no", (place - 1).cast("long")))


def assign_located(located: DataFrame, anchors: DataFrame, metres: float, grid: Grid) -> DataFrame:
    """Replaces ``ord`` by the struct ``home``: the nearest earlier of the numbered anchors, ties to the earlier.

    A cell is in reach of a bounded number of anchors, because a cell has at
    most one; they travel as one short array per cell.
    """
    lists = (
        grid.spread(anchors)
        .groupBy(*CELL)
        .agg(F.collect_list(F.struct("lat", "lon", "ord", "cluster_no")).alias("near"))
    )
    ranked = F.transform(
        F.filter("near", lambda a: a["ord"] <= F.col("ord")),
        lambda a: F.struct(
            haversine(F.col("lat"), F.col("lon"), a["lat"], a["lon"]).alias("metres"),
            a["cluster_no"].alias("cluster_no"),
            a["lat"].alias("lat"),
            a["lon"].alias("lon"),
        ),
    )
    nearest = F.array_min(ranked)
    return (
        grid.place(located)
        .join(lists.hint("merge"), CELL)
        .withColumn("nearest", nearest)
        .withColumn("home", F.struct("nearest.cluster_no", "nearest.lat", "nearest.lon"))
        .drop("near", "nearest", "cy", "cx", "ord")
    )


def _reachable(bound: DataFrame, homes: DataFrame, rules: Rules) -> DataFrame:
    """(name_key, station_id, coarse_lat, coarse_lon, home): homes of that id that a coarse point accepts.

    Both meet in cells of the coarse grid.  Anchors of a name keep their distance,
    so a cell holds a bounded number of them, however many the name has.
    """
    metres, cell_side = rules.match_metres, 2 * rules.coarse_half_cell
    up = rules.coarse_half_cell + 1.001 * metres / METRES_PER_DEGREE
    widest = max(abs(rules.box.lat_min), abs(rules.box.lat_max)) + 2 * cell_side
    aside = rules.coarse_half_cell + 1.001 * metres / (METRES_PER_DEGREE * math.cos(math.radians(widest)))

    def around(value: Column, reach: float) -> Column:
        low, high = cell(value - reach, cell_side), cell(value + reach, cell_side)
        return F.explode(F.sequence(low, high))

    asked = bound.withColumn("cy", around(F.col("coarse_lat"), up)).withColumn("cx", around(F.col("coarse_lon"), aside))
    placed = homes.withColumn("cy", cell(F.col("home.lat"), cell_side)).withColumn("cx", cell(F.col("home.lon"), cell_side))
    met = join_null_safe(asked, placed, ["name_key", "station_id", "cy", "cx"], "inner")
    none = F.lit(0).cast("long")
    fits = coarse_cell_contains(
        F.col("coarse_lat"), F.col("coarse_lon"), none, F.col("home.lat"), F.col("home.lon"), rules
    )
    return met.filter(fits).drop("cy", "cx")


def _two_first(present: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group, the first home that is there (``one``) and when the second is (``two``)."""
    ranked = present.withColumn(
        "place", F.row_number().over(Window.partitionBy(*keys).orderBy("since", "home"))
    ).filter("place <= 2")

    def at(place: int, column: str) -> Column:
        return F.max(F.when(F.col("place") == place, F.col(column)))

    return ranked.groupBy(*keys).agg(at(1, "home").alias("one"), at(1, "since").alias("one_since"), at(2, "since").alias("two_since"))


def attach_unlocated(missing: DataFrame, homed: DataFrame, anchors: DataFrame, rules: Rules) -> DataFrame:
    """Adds ``home`` to rows without a location; NULL leaves them unlocated.

    Rows ask for counts and minima only: how many homes of their name and id they
    accept, and which if it is one.  A row without a coarse point accepts all, so
    totals per (name, id) answer; the others are asked once per coarse point.
    """
    point, named_id = ["coarse_lat", "coarse_lon"], ["name_key", "station_id"]
    named = anchors.groupBy("name_key").agg(
        F.count(F.lit(1)).alias("anchors"), F.min(F.struct("cluster_no", "lat", "lon")).alias("only")
    )
    homes = checkpoint(homed.select(*named_id, "archive", "home").distinct())
    by_id = homes.select(*named_id, "home").distinct()
    of_id = by_id.groupBy(*named_id).agg(F.count(F.lit(1)).alias("id_homes"), F.min("home").alias("id_home"))
    free = F.col("coarse_lat").isNull() | (F.coalesce("coordinate_count", F.lit(0)) > 0)
    only = F.col("only")
    fits_only = coarse_cell_contains(
        F.col("coarse_lat"), F.col("coarse_lon"), F.col("coordinate_count"), only["lat"], only["lon"], rules
    )
    rows = missing.withColumn("pos", file_order()).withColumn("free", free).join(named, "name_key", "left")
    rows = join_null_safe(rows, of_id, named_id).withColumn("fits_only", fits_only)
    rows = checkpoint(rows)

    bound = rows.filter("NOT free AND anchors > 1 AND id_homes IS NOT NULL").select(*named_id, *point).distinct()
    reachable = checkpoint(_reachable(bound, by_id, rules))
    reached = reachable.groupBy(*named_id, *point).agg(F.count(F.lit(1)).alias("n_near"), F.min("home").alias("near_home"))
    nullable = frozenset({"station_id", *point})
    rows = join_null_safe(rows, reached, [*named_id, *point], nullable=nullable)
    accepted = F.when(F.col("free"), F.col("id_homes")).otherwise(F.col("n_near"))
    match = F.when(F.col("free"), F.col("id_home")).otherwise(F.col("near_home"))
    rows = checkpoint(rows.withColumn("matches", F.coalesce(accepted, F.lit(0))).withColumn("match", match))

    # One anchor: rows are attached freely until the first that does not fit;
    # later ones need an id that some attached row already has.
    single = rows.filter("anchors = 1")
    first_misfit = (
        single.filter("NOT fits_only").groupBy("name_key").agg(F.min("pos").alias("misfit"))
    )
    id_first = single.groupBy(*named_id).agg(F.min("pos").alias("id_pos"))

    # Several anchors: rows with one match lend their (archive, id) to it, from
    # their position on; homes of located rows are there from the start.
    with_archive = ["name_key", "archive", "station_id"]
    lent = (
        rows.filter("anchors > 1 AND matches = 1")
        .groupBy(*with_archive, F.col("match").alias("home"))
        .agg(F.min("pos").alias("pos"))
    )
    nowhere = F.lit(None).cast(dict(rows.dtypes)["pos"])
    present = homes.select(*with_archive, "home", F.struct(F.lit(0).alias("lent"), nowhere.alias("pos")).alias("since")).unionByName(
        lent.select(*with_archive, "home", F.struct(F.lit(1).alias("lent"), F.col("pos")).alias("since"))
    )
    present = checkpoint(present.groupBy(*with_archive, "home").agg(F.min("since").alias("since")))
    of_archive = _two_first(present, with_archive)
    several = rows.filter("anchors > 1 AND matches > 1 AND NOT free").select(*with_archive, *point).distinct()
    near_present = join_null_safe(several, reachable, [*named_id, *point], "inner", nullable)
    near_present = join_null_safe(near_present, present, [*with_archive, "home"], "inner")
    of_point = _two_first(near_present, [*with_archive, *point])

    judged = rows.join(first_misfit, "name_key", "left")
    judged = join_null_safe(judged, id_first, named_id)
    judged = join_null_safe(judged, of_archive.select(*with_archive, F.struct("one", "one_since", "two_since").alias("all_there")), with_archive)
    judged = join_null_safe(
        judged,
        of_point.select(*with_archive, *point, F.struct("one", "one_since", "two_since").alias("near_there")),
        [*with_archive, *point],
        nullable=nullable,
    )
    known_id = F.col("id_homes").isNotNull() | (F.col("id_pos") < F.col("misfit"))
    before_misfit = F.col("misfit").isNull() | (F.col("pos") < F.col("misfit"))
    joins_only = before_misfit | (F.col("fits_only") & F.coalesce(known_id, F.lit(False)))
    judged = judged.withColumn("there", F.when(F.col("free"), F.col("all_there")).otherwise(F.col("near_there")))

    def by_then(since: Column) -> Column:
        return F.coalesce((since["lent"] == 0) | (since["pos"] < F.col("pos")), F.lit(False))

    alone = by_then(F.col("there.one_since")) & ~by_then(F.col("there.two_since"))
    home = (
        F.when((F.col("anchors") == 1) & joins_only, F.col("only"))
        .when((F.col("anchors") > 1) & (F.col("matches") == 1), F.col("match"))
        .when((F.col("anchors") > 1) & (F.col("matches") > 1) & alone, F.col("there.one"))
    )
    return judged.select(*missing.columns, home.alias("home"))


def cluster_by_name(
    obs: DataFrame, metres: float | None = None, rules: Rules = DEFAULT, stored: bool = False
) -> DataFrame:
    """Observations with their cluster: number, anchor, ambiguity and entity key.

    ``stored`` says that ``obs`` is read from a table, so it need not be written once more.
    """
    metres = rules.match_metres if metres is None else metres
    grid = Grid(metres, rules)
    if "original_station_name" not in obs.columns:
        obs = obs.withColumn("original_station_name", F.col("station_name"))
    if not stored:
        obs = checkpoint(obs)
    has_point = in_box(F.col("lat"), F.col("lon"), rules.box)
    located, missing = obs.filter(has_point).withColumn("ord", support_order()), obs.filter(~has_point)
    anchors = number_anchors(find_anchors(located, metres, grid))
    homed = checkpoint(assign_located(located, anchors, metres, grid))
    attached = attach_unlocated(missing, homed, anchors, rules).withColumn(
        "coordinate_inferred", F.col("coordinate_inferred") | F.col("home").isNotNull()
    )
    attached = checkpoint(attached)
    clusters = (
        anchors.groupBy("name_key")
        .agg(F.count(F.lit(1)).alias("anchors"))
        .join(
            attached.filter("home IS NULL").select("name_key", F.lit(1).alias("loose")).distinct(),
            "name_key",
            "full_outer",
        )
        .select(
            "name_key",
            F.coalesce("anchors", F.lit(0)).alias("anchors"),
            (F.coalesce("anchors", F.lit(0)) + F.coalesce("loose", F.lit(0))).alias("clusters"),
        )
    )
    rows = homed.unionByName(attached)
    lat, lon = F.col("home.lat"), F.col("home.lon")
    return (
        rows.join(clusters, "name_key")
        .withColumn("cluster_no", F.coalesce("home.cluster_no", "anchors").cast("long"))
        .withColumn("anchor_lat", lat)
        .withColumn("anchor_lon", lon)
        .withColumn("ambiguous", F.col("home").isNull() & (F.col("anchors") > 0))
        .withColumn("many_locations", F.col("clusters") > 1)
        .withColumn("station_key", entity_key(F.col("name_key"), lat, lon, rules))
        .drop("home", "anchors", "clusters")
    )
