"""The census of trip ends and what is read from it; skewed keys of joins, aliases and clusters."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from fixtures import observation, observations
from pyspark.sql import functions as F

from placetrace.operators import aliases, observe, profile
from placetrace.operators.cluster import cluster_by_name
from placetrace.operators.joins import split_join
from placetrace.operators.matching import feed_rows
from placetrace.operators.spatial import edge_cells, point_in_boundary
from placetrace.session import SPLIT_BYTES, checkpoint_large, small_tasks
from placetrace.sources.boundary import edges_from_rings

TRIP = (
    "archive string, member string, schema string, trip_id string, started_at timestamp_ntz, ended_at timestamp_ntz,"
    " start_station_id string, start_station_name string, end_station_id string, end_station_name string,"
    " start_lat double, start_lon double, end_lat double, end_lon double"
)


def trips(spark, n=3000, seed=1):
    rng = random.Random(seed)
    day = datetime(2020, 1, 1)
    rows = []
    for i in range(n):
        start = day + timedelta(minutes=rng.randrange(5000))
        at = rng.choice([start, start + timedelta(minutes=9), start - timedelta(minutes=5), None])
        place = lambda: (rng.choice(["1", "2", None]), rng.choice(["Elm", "Oak", None]))
        spot = lambda: rng.choice([(None, None), (41.9, -87.6), (0.0, 0.0), (41.9 + rng.random() / 1e3, -87.6 - rng.random() / 1e3)])
        a, b, p, q = place(), place(), spot(), spot()
        rows.append(("x", rng.choice(["a", "b"]), "modern", rng.choice([f"t{i}", f"t{i % 50}", None]),
                     rng.choice([start, start, start, None]), at, *a, *b, *p, *q))
    return rows, spark.createDataFrame(rows, TRIP)


def by_hand(rows):
    ends = {}
    for r in rows:
        valid = r[4] is not None and r[5] is not None and r[5] >= r[4]
        for role, at, sid, name, lat, lon in (("start", r[4], r[6], r[7], r[10], r[11]), ("end", r[5], r[8], r[9], r[12], r[13])):
            ends.setdefault((r[1], sid, name, role), []).append((valid, at, r[3], lat, lon))
    out = {}
    for key, many in ends.items():
        good = [e for e in many if e[0]]
        inside = [e for e in good if e[3] is not None and 41.4 <= e[3] <= 42.3 and -88.1 <= e[4] <= -87.3]
        coarse = [e for e in inside if abs(e[3] - round(e[3], 2)) < 1e-9 and abs(e[4] - round(e[4], 2)) < 1e-9]
        fine = [e for e in inside if e not in coarse]
        q = lambda part, axis, p: float(np.quantile([e[axis] for e in part], p)) if part else None
        named = [(e[1], e[2]) for e in good if e[2] is not None]
        out[key] = (
            len(many), len(good), min((e[1] for e in good), default=None), max((e[1] for e in good), default=None),
            min(named, default=(None, None))[1], len(fine), len(coarse), q(coarse, 3, 0.5), q(fine, 3, 0.5), q(fine, 3, 0.05), q(fine, 4, 0.95),
        )
    return out


@pytest.mark.parametrize("light", [observe.LIGHT, 20, 0], ids=["all light", "some heavy", "all heavy"])
def test_observations_equal_counting_by_hand(spark, light):
    rows, df = trips(spark)
    counted = observe.checkpoint(observe.census(df))
    found = observe.observe_census(counted, light=light).collect()
    expected = by_hand(rows)
    assert len(found) == len(expected)
    for r in found:
        e = expected[(r.member, r.station_id, r.station_name, r.role)]
        mine = (r.endpoint_count, r.valid_endpoint_count, r.first_at, r.last_at, r.first_trip_id, r.coordinate_count, r.coarse_coordinate_count)
        assert mine == e[:7]
        assert [r.coarse_lat, r.lat, r.lat_p05, r.lon_p95] == [None if x is None else pytest.approx(x, abs=1e-9) for x in e[7:]]


@pytest.mark.parametrize("light", [observe.LIGHT, 20, 0], ids=["all light", "some heavy", "all heavy"])
def test_roll_up_of_trips_without_a_census(spark, light, monkeypatch):
    """Whole ends are neither shuffled nor stored, and the rows are those of the census."""
    _, df = trips(spark)
    expected = sorted(map(repr, observe.observe_census(observe.checkpoint(observe.census(df))).collect()))
    monkeypatch.delattr(observe, "census")
    assert sorted(map(repr, observe.observe_stored(df, light=light).collect())) == expected


def test_profile_from_the_census(spark):
    rows, df = trips(spark)
    for r in profile.profile_trips(df).collect():
        mine = [x for x in rows if x[1] == r.member]
        assert r.rows == len(mine) and r.missing_trip_ids == sum(x[3] is None for x in mine)
        assert r.duplicate_or_missing_trip_ids == len(mine) - len({x[3] for x in mine} - {None})
        assert r.distinct_start_ids == len({x[6] for x in mine} - {None})
        assert r.reversed_trips == sum(x[4] is not None and x[5] is not None and x[5] < x[4] for x in mine)
        assert r.zero_duration_trips == sum(x[4] is not None and x[5] == x[4] for x in mine)
        assert r.invalid_end_time == sum(x[5] is None for x in mine)
        assert r.invalid_start_coordinates == sum(x[10] == 0.0 for x in mine)
        assert r.missing_end_coordinates == sum(x[12] is None for x in mine)
        assert r.earliest_start == min(x[4] for x in mine if x[4]) and r.latest_end == max(x[5] for x in mine if x[5])


def test_trips_are_scanned_once(spark, tmp_path):
    trips(spark, 50)[1].write.parquet(str(tmp_path / "t"))
    plan = observe.census(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_split_join_with_a_key_that_is_hot_on_both_sides(spark):
    left = [("hot", i) for i in range(90)] + [("a", 100), ("none", 101)]
    right = [("hot", i) for i in range(70)] + [("a", 200), ("b", 201)]
    a, b = spark.createDataFrame(left, "k string, i long"), spark.createDataFrame(right, "k string, j long")
    got = split_join(a, b, ["k"], ["i"], block=20).select("k", "i", "j").collect()
    assert len(got) == len(set(got)) == 90 * 70 + 1
    close = split_join(a, b, ["k"], ["i"], condition=F.col("i") == F.col("j"), block=20)
    assert close.count() == 70


def test_many_entities_on_one_spot_without_a_shared_id_form_no_pairs(spark):
    n = 5000
    key = F.concat(F.lit("k"), F.col("id"))
    entities = spark.range(n).select(
        key.alias("station_key"), key.alias("station_name"), F.lit("station").alias("station_type"),
        F.lit(datetime(2020, 1, 1)).cast("timestamp_ntz").alias("station_first_trip_at"),
        F.lit(41.9).alias("station_lat"), F.lit(-87.6).alias("station_lon"),
    )
    shared = F.when(F.col("id") < 3, "same").otherwise(F.col("id").cast("string"))
    rows = spark.range(n).select(key.alias("station_key"), key.alias("name_key"), F.lit(0).alias("cluster_no"), shared.alias("station_id"))
    pairs = aliases.near_pairs(entities, rows).collect()
    assert len(pairs) == 3 and all(r.source_id == "same" for r in pairs)


def test_a_name_of_many_anchors_and_a_null_id(spark):
    """Unlocated rows of a crowded name ask for counts and get the anchor that alone fits."""
    spots = [(41.5 + 0.004 * i, -88.0 + 0.006 * j) for i in range(25) for j in range(25)]
    rows = [observation(None, "Mobile", lat, lon, first_trip_id=f"s{i}", valid_endpoint_count=100 + i) for i, (lat, lon) in enumerate(spots)]
    free = observation(None, "Mobile", first_trip_id="free", archive="z")
    alone = observation(None, "Mobile", first_trip_id="alone", archive="z", coarse_lat=42.2, coarse_lon=-87.4, coarse_coordinate_count=3)
    edge = observation(None, "Mobile", first_trip_id="edge", archive="z", coarse_lat=41.49, coarse_lon=-88.01, coarse_coordinate_count=3)
    got = {r.first_trip_id: r for r in cluster_by_name(observations(spark, [*rows, free, alone, edge])).collect()}
    assert got["free"].ambiguous and got["alone"].ambiguous and got["free"].anchor_lat is None
    near = [s for s in spots if abs(max(41.485, min(s[0], 41.495)) - s[0]) < 0.0013 and abs(max(-88.015, min(s[1], -88.005)) - s[1]) < 0.0018]
    assert (got["edge"].anchor_lat is not None) == (len(near) == 1)


def test_boundary_cells_equal_brute_force(spark):
    rng = random.Random(9)
    star = [(np.cos(t) * r + 0.005, np.sin(t) * r) for t, r in zip(np.linspace(0, 2 * np.pi, 25)[:-1], [0.09, 0.04] * 12)]
    hole = [(0.01, 0.01), (0.02, 0.01), (0.02, 0.02), (0.01, 0.02)]
    ring = [("p", 0, i, float(x), float(y)) for i, (x, y) in enumerate(star)] + [("p", 1, i, x, y) for i, (x, y) in enumerate(hole)]
    edges = edges_from_rings(spark.createDataFrame(ring, "polygon string, ring int, place int, x double, y double"))
    points = [(rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1)) for _ in range(1500)] + [(0.01, 0.015), (0.0, 0.0), (0.01, 0.01)]

    def inside(lat, lon):
        odd = False
        for part in (star, hole):
            for (x1, y1), (x2, y2) in zip(part, part[1:] + part[:1]):
                if (x2 - x1) * (lat - y1) == (y2 - y1) * (lon - x1) and min(x1, x2) <= lon <= max(x1, x2) and min(y1, y2) <= lat <= max(y1, y2):
                    return True
                if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                    odd = not odd
        return odd

    df = spark.createDataFrame(points, "lat double, lon double")
    for block in (2048, 10):
        got = {(r.lat, r.lon): r.in_city for r in point_in_boundary(df, edges, block).collect()}
        assert got == {p: inside(*p) for p in points}
    assert edge_cells(edges).count() < 20 * 20


def test_feeds_may_leave_out_fields(spark):
    city = spark.createDataFrame([("1", "Elm", "41.9", "-87.6")], "id string, station_name string, latitude string, longitude string")
    info = spark.createDataFrame([], "station_id string, name string, short_name string, lat double, lon double, station_type string, capacity int")
    status = spark.createDataFrame([], "station_id string, is_installed int, is_renting int, is_returning int")
    row = feed_rows(city, info, status).first()
    assert (row.short_name, row.status, row.capacity) == ("", None, None)


def test_whole_tables_are_stored_for_tasks_of_bounded_size(spark):
    """However few tasks write a table, its files hold a bounded number of rows and are read by a task each."""
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(key) for key in settings]
    stored = checkpoint_large(spark.range(0, 1000, 1, 1), file_rows=100)
    assert len(stored.inputFiles()) == 10 and stored.count() == 1000
    with pytest.raises(ZeroDivisionError), small_tasks(spark):
        assert int(spark.conf.get(settings[0])) == SPLIT_BYTES
        raise ZeroDivisionError
    assert [spark.conf.get(key) for key in settings] == before
