"""What steps move, keep and send to the driver, on rows of their own."""

from __future__ import annotations

import glob
import time
from datetime import date

from pyspark.sql import functions as F
from test_census import trips

from placetrace import session
from placetrace.operators import cluster, observe, profile
from placetrace.params import DEFAULT
from placetrace.plans import adapters


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*.data")}


def test_a_written_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    table = session.checkpoint(grouped)
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and table.count() == 7


def test_a_written_step_broadcasts_small_files_only(spark):
    text = F.concat(*[F.sha2((F.col("id") + i).cast("string"), 256) for i in range(2)]).alias("text")
    large, small = session.checkpoint(spark.range(20_000).select("id", text)), session.checkpoint(spark.range(50))
    rows = spark.range(100_000)
    before = {key: spark.conf.get(key, None) for key in (session.BROADCAST, session.MEASURED, session.CLEANUP)}
    assert "BroadcastHashJoin" in plan(rows.join(large, "id"))
    with session.writing(spark):
        assert "BroadcastHashJoin" not in plan(rows.join(large, "id"))
        assert "BroadcastHashJoin" in plan(rows.join(small, "id"))
    assert before == {key: spark.conf.get(key, None) for key in before}
    with session.settings(spark, {session.BROADCAST: "64k"}), session.writing(spark):
        assert spark.conf.get(session.BROADCAST) == "65536"
    with session.settings(spark, {session.BROADCAST: "-1"}), session.writing(spark):
        assert "BroadcastHashJoin" not in plan(rows.join(small, "id"))


def test_anchors_copied_to_cells_are_not_broadcast(spark):
    rows = spark.range(40).withColumns({"lat": 41.9 + F.col("id") * 1e-4, "lon": F.lit(-87.6)})
    rows = rows.select(F.lit("elm").alias("name_key"), "lat", "lon", F.struct("id", "lat", "lon").alias("ord"))
    rows, grid = session.checkpoint(rows), cluster.Grid(150, DEFAULT)
    anchors = cluster.number_anchors(cluster.find_anchors(rows, 150, grid))
    text = plan(cluster.assign_located(rows, anchors, 150, grid))
    assert anchors.count() > 1 and "BroadcastHashJoin" not in text and "SortMergeJoin" in text


def test_ends_of_stored_trips_move_once_and_without_codes(spark):
    _, df = trips(spark)
    stored = session.checkpoint(df)
    text = plan(observe.observe_stored(stored))
    assert text.count("Exchange hashpartitioning") == 1 and "Window" not in text
    moved = text[text.index("Exchange") :].split("\n", 1)[1]
    assert "code_a" not in moved and "code_b" not in moved


def test_profile_without_a_census(spark):
    _, df = trips(spark)
    expected = sorted(map(repr, profile.profile_trips(df).collect()))
    found = profile.profile_trips(df, ends=observe.single_ends(df))
    assert "lat#" not in "".join(line for line in plan(found).split("\n") if "Exchange" in line)
    assert sorted(map(repr, found.collect())) == expected


def test_trips_are_joined_by_keys_and_places_made_afterwards(spark, tmp_path):
    """Keys that repeat, are missing or have no row, as when whole place rows were joined."""
    days = [date(1993, 2, 1), date(1996, 5, 3), None]
    tables = {
        "customer": spark.createDataFrame([(k,) for k in (1, 2, 2, 83, 400, None)], "c_custkey long"),
        "supplier": spark.createDataFrame([(k,) for k in (20, 20, 44, 181, None)], "s_suppkey long"),
        "orders": spark.createDataFrame(
            [(i, (1, 2, 83, 400, 7, None)[i % 6], days[i % 3]) for i in range(60)] + [(3, 1, days[1]), (None, 1, days[1])],
            "o_orderkey long, o_custkey long, o_orderdate date",
        ).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")),
        "lineitem": spark.createDataFrame(
            [(i % 64, i % 5, (20, 44, 181, 9, None)[i % 5], (i * 7) % 1500, days[i % 3]) for i in range(300)],
            "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_shipdate date",
        ).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    starts = adapters._chain(tables["customer"], adapters.START_PLACES)
    ends = adapters._chain(tables["supplier"], adapters.END_PLACES)
    joined = tables["lineitem"].join(tables["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    placed = adapters._chain(joined, adapters.TRIPS[:1]).join(starts, F.col("k1") == F.col("a_key"))
    expected = adapters._chain(placed.join(ends, F.col("k2") == F.col("b_key")), adapters.TRIPS[1:])
    found = adapters.trips(spark, str(tmp_path))
    assert found.schema == expected.schema
    below = plan(found)
    below = below[below.index("Join") :]
    assert "a_name" not in below and "b_name" not in below and "upper" not in below
    rows = sorted(map(repr, found.collect()))
    assert rows == sorted(map(repr, expected.collect())) and len(rows) > 100
