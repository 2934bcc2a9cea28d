from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from placetrace.operators.joins import pairs_within, split_join
from placetrace.operators.members import previous_copy
from placetrace.operators.spatial import distance_join, point_in_boundary
from placetrace.sources.boundary import edges_from_rings


def test_pairs_within_splits_a_hot_key(spark):
    rows = [("hot", i) for i in range(30)] + [("a", 100), ("a", 101), ("b", 200)]
    df = spark.createDataFrame(rows, "k string, i long")
    for block in (4, 1000):
        got = pairs_within(df, ["k"], "i", block).select("k", "a.i", F.col("b.i").alias("j")).collect()
        assert len(got) == 30 * 29 // 2 + 1 == len(set(got))
        assert all(r.i < r.j for r in got)


def test_split_join_equals_join(spark):
    rng = random.Random(1)
    left = [("hot" if i % 3 == 0 else f"k{rng.randint(0, 9)}", i) for i in range(300)]
    right = [("hot", 1), ("hot", 2), ("k3", 3), ("none", 4)]
    a = spark.createDataFrame(left, "k string, i long")
    b = spark.createDataFrame(right, "k string, j long")
    plain = sorted(map(tuple, a.join(b, "k").collect()))
    assert sorted(map(tuple, split_join(a, b, ["k"], ["i"], block=10).select("k", "i", "j").collect())) == plain


def test_distance_join_equals_brute_force(spark):
    rng = random.Random(2)

    def points(n):
        return [(i, 41.9 + rng.uniform(-0.01, 0.01), -87.6 + rng.uniform(-0.01, 0.01)) for i in range(n)]

    a, b = points(150), points(150)
    a += [(1000 + i, 41.9, -87.6) for i in range(50)]

    def metres(p, q):
        lat1, lon1, lat2, lon2 = map(math.radians, (*p[1:], *q[1:]))
        h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    expected = {(p[0], q[0]) for p in a for q in b if metres(p, q) <= 150}
    frames = [spark.createDataFrame(rows, "i long, lat double, lon double") for rows in (a, b)]
    for block in (7, 2048):
        got = distance_join(*frames, 150.0, "i", "i", block=block).select("a_i", "b_i").collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_distance_join_everywhere_on_the_globe(spark):
    rng = random.Random(3)

    def metres(p, q):
        lat1, lon1, lat2, lon2 = map(math.radians, (*p[1:], *q[1:]))
        h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
        return 2 * 6371000 * math.asin(min(1.0, math.sqrt(h)))

    points = []
    for lat in (0.0, -60.0, 70.0, 85.0, 89.9995, -89.9999):
        for lon in (-87.6, 179.9999, -180.0):
            for _ in range(14):
                spread = 0.0015 / max(math.cos(math.radians(lat)), 1e-4)
                high = max(-90.0, min(90.0, lat + rng.uniform(-0.0015, 0.0015)))
                points.append((len(points), high, (lon + rng.uniform(-spread, spread) + 180) % 360 - 180))
    points += [(len(points), 90.0, 12.0), (len(points) + 1, 0.0, 180.0), (len(points) + 2, 0.0, -180.0)]
    expected = {(p[0], q[0]) for p in points for q in points if metres(p, q) <= 150}
    rows = spark.createDataFrame(points, "i long, lat double, lon double")
    got = distance_join(rows, rows, 150.0, "i", "i").select("a_i", "b_i").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) > 2 * len(points)


def test_boundary_edges_holes_and_parts(spark):
    rings = [("p", 0, [(0, 0), (4, 0), (4, 4), (0, 4)]), ("p", 1, [(1, 1), (2, 1), (2, 2), (1, 2)]),
             ("q", 0, [(10, 0), (12, 0), (11, 2)])]
    rows = [(p, r, i, float(x), float(y)) for p, r, pts in rings for i, (x, y) in enumerate(pts)]
    edges = edges_from_rings(spark.createDataFrame(rows, "polygon string, ring int, place int, x double, y double"))
    expected = {(0.5, 0.5): True, (1.5, 1.5): False, (1.0, 1.5): True, (4.0, 2.0): True, (4.1, 2.0): False,
                (2.0, 4.0): True, (11.0, 1.0): True, (10.1, 1.9): False, (0.0, 0.0): True, (5.0, 0.0): False}
    points = [(lat, lon) for lon, lat in expected] + [(None, 1.0)]
    got = {(r.lon, r.lat): r.in_city for r in point_in_boundary(
        spark.createDataFrame(points, "lat double, lon double"), edges).collect()}
    assert got == {**expected, (1.0, None): None}


def test_previous_copy_in_small_blocks(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaab"), f"f{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "pos long, sha string, path string")
    last, expected = {}, {}
    for pos, sha, path in rows:
        expected[pos] = last.get(sha)
        last[sha] = path
    for block in (1, 5, 1000):
        got = previous_copy(df, ["sha"], "pos", "path", "duplicate_of", block).collect()
        assert {r.pos: r.duplicate_of for r in got} == expected


def test_distance_join_broadcasts_no_copies(spark, tmp_path):
    """A small file may hold rows that fill a driver's memory once they are copied to nine cells."""
    points = spark.range(200).selectExpr("id AS i", "41.9D + id * 1e-5 AS lat", "-87.6D AS lon")
    points.write.parquet(str(tmp_path / "points"))
    stored = spark.read.parquet(str(tmp_path / "points"))
    joined = distance_join(stored, stored, 150.0, "i", "i")
    joined.collect()
    plan = joined._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
