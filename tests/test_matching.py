from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from placetrace.operators import checks, matching
from placetrace.params import REGION_COLUMNS
from placetrace.plans import stages

ENTITY = (
    "station_key string, station_name string, name_variants string, source_ids string, station_type string,"
    " station_lat double, station_lon double, station_first_trip_at timestamp_ntz,"
    " station_last_trip_at timestamp_ntz, endpoint_count bigint, quality_flags string"
)
FEED = (
    "source string, feed_station_id string, short_name string, station_name string, name_key string,"
    " name_class string, station_lat double, station_lon double, status string, feed_station_type string"
)


def entity(key, name, ids, kind="station", lat=41.9001, flags=""):
    return (key, name, name, ids, kind, lat, -87.6501, datetime(2013, 6, 27), datetime(2026, 8, 31), 100, flags)


def entities(spark, *rows):
    return spark.createDataFrame(list(rows), ENTITY)


def feed(spark, *more):
    row = ("city", "uuid", "X001", "Elm St & First Ave", "elm st & first ave", "station", 41.9001, -87.6501, "In Service", "")
    return spark.createDataFrame([row, *more], FEED)


def resolved(spark, ents, feeds=None):
    return matching.resolve_matches(matching.match_candidates(ents, feeds or feed(spark))).collect()


def test_reused_id_far_away(spark):
    rows = resolved(spark, entities(spark, entity("a", "Old place", "X001", lat=41.7)))
    assert [r.accepted for r in rows] == [False]


def test_similar_name_is_for_review_only(spark):
    rows = resolved(spark, entities(spark, entity("a", "Elm Street & First Avenue", "old-id")))
    assert len(rows) == 1 and rows[0].name_similarity > 0.65 and not rows[0].accepted
    # Seven letters go: "reet" becomes "" after "st", and "nue" after "ave".
    assert rows[0].name_similarity == pytest.approx(1 - 7 / 25, abs=1e-4)


def test_pairs_that_are_only_near_are_not_formed_for_matches(spark):
    ents = entities(spark, entity("a", "Elm Street & First Avenue", "old-id"), entity("b", "Elm St & First Ave", "X001"))
    found = matching.match_candidates(ents, feed(spark))
    assert {(r.station_key, r["rank"], r.exact_name, r.shared_short_name) for r in found.collect()} == {
        ("a", 99, False, False), ("b", 0, True, True)
    }
    usable = found.filter("rank < 99")
    assert "__y" not in usable._jdf.queryExecution().optimizedPlan().toString()
    assert [r.station_key for r in usable.collect()] == ["b"]


def test_two_claims_cancel(spark):
    ents = entities(spark, *[entity(k, "Elm St & First Ave", "X001") for k in "ab"])
    rows = resolved(spark, ents)
    assert len(rows) == 2 and not any(r.accepted for r in rows)


def test_rack_is_not_a_station(spark):
    rows = resolved(spark, entities(spark, entity("a", "Public Rack - Elm St & First Ave", "X001", "public_rack")))
    assert not any(r.accepted for r in rows)


def test_unlocated_entity_keeps_name_and_id_pairs(spark):
    rows = resolved(spark, entities(spark, entity("a", "Elm St & First Ave", "", lat=None)))
    assert [(r.distance_meters, r.accepted, r.exact_name) for r in rows] == [(None, False, True)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[j - 1] + 1))
    return row[-1]


def test_blocked_joins_equal_all_pairs(spark):
    ents = entities(spark, *[
        entity(f"e{i}", ["Elm St", "Oak St", "Fir Ln"][i % 3], ["1 | 2", "3", ""][i % 3], lat=41.9 + i * 0.0004)
        for i in range(12)])
    feeds = feed(spark, *[
        ("gbfs", f"g{i}", str(i % 4), n, n.lower(), "station", 41.9 + i * 0.0005, -87.6501, "x", "")
        for i, n in enumerate(["Elm St", "Oak Ave", "Fir Lane", "Pine", "Elm St", "Oak St"])])
    pairs = matching.match_candidates(ents, feeds).select("station_key", "feed_station_id")
    a = ents.selectExpr("station_key", "lower(station_name) n", "split(source_ids, ' [|] ') ids", "station_lat la", "station_lon lo")
    b = feeds.selectExpr("feed_station_id", "name_key", "short_name", "station_lat lb", "station_lon lp")
    from placetrace.functions.geo import haversine

    gap = haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp"))
    everything = a.crossJoin(b).withColumn("gap", gap).collect()
    expected = set()
    for r in everything:
        known = r.n == r.name_key or (r.short_name and r.short_name in r.ids)
        alike = 1 - edits(r.n, r.name_key) / max(len(r.n), len(r.name_key)) >= 0.65 or r.gap <= 35
        if known or (r.gap <= 150 and alike):
            expected.add((r.station_key, r.feed_station_id))
    got = [tuple(r) for r in pairs.collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_reconciled_columns_and_coverage(spark):
    ents = entities(spark, entity("a", "Elm St & First Ave", "X001", flags="possible_rename"), entity("b", "Oak", "9", lat=41.8))
    feeds = feed(spark, ("gbfs", "g1", "", "Nowhere", "nowhere", "station", 41.5, -87.7, "ok", "classic"))
    feeds = feeds.withColumn("in_city", F.lit(True))
    found = matching.resolve_matches(matching.match_candidates(ents, feeds))
    out = {r.station_key: r for r in matching.reconcile(ents, feeds, found, "2026-01-01").collect()}
    assert (out["a"].city_station_id, out["a"].current_feed_match_status) == ("uuid", "matched")
    assert out["a"].service_date_review_reasons == "possible_rename" and out["a"].gbfs_station_id is None
    assert out["b"].current_feed_match_status == "no_confirmed_match"
    covered = matching.coverage(feeds, found, ents)
    assert {r.feed_station_id: r.coverage_status for r in covered.collect()} == {
        "uuid": "matched", "g1": "no_unambiguous_history_match"}
    counts = {r.source: (r.rows, r.matched) for r in matching.coverage_counts(covered).collect()}
    assert counts == {"city": (1, 1), "gbfs": (1, 0)}


def test_reconciled_stores_no_pairs_that_are_only_near(spark, monkeypatch):
    """Crowded sites: 60 entities and 60 feed rows on one spot under names of their own, but for one."""
    ents = entities(spark, *[entity(f"e{i}", f"Old {i}", f"o{i}") for i in range(60)], entity("a", "Elm St & First Ave", "X001"))
    feeds = feed(spark, *[
        ("gbfs", f"g{i}", f"n{i}", f"New {i}", f"new {i}", "station", 41.9001, -87.6501, "ok", "classic") for i in range(60)])
    monkeypatch.setattr(stages, "_DONE", {})
    for name, rows in {"entities": ents, "flagged": ents, "feeds": feeds}.items():
        monkeypatch.setattr(stages.Stages, name, lambda self, rows=rows: rows)
    got = stages.Stages(spark, "crowded").reconciled()
    everything = matching.resolve_matches(matching.match_candidates(ents, feeds))
    assert everything.count() > 60 * 60
    expected = matching.reconcile(ents, feeds, everything, "2026-09-15")
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert all(df.count() <= 61 for df in stages._DONE.values())


REFERENCE = (
    "station_key string, city_station_id string, station_first_trip_at timestamp_ntz, source_ids string,"
    " name_variants string, first_trip_archive string, opening_date_status string,"
    " earlier_same_name_trip_at timestamp_ntz, service_date_review_reasons string"
)


def reference(spark, *ids):
    rows = [(f"k{i}", i, datetime(2020, 1, 1), "1", "Elm", "a", "proxy", None, "") for i in ids]
    return spark.createDataFrame(rows, REFERENCE)


def test_inventory_keeps_rows_and_columns(spark):
    region = ":@computed_region_43wa_7qmu"
    city = spark.createDataFrame([("0001", "Elm", ("Point", [1.0, 2.0]), "5"), ("0002", "Elm", None, None)],
        f"id string, station_name string, location struct<type:string,coordinates:array<double>>, `{region}` string")
    declared = [{"fieldName": "id", "position": 1}, {"fieldName": "unused", "position": 2}, {"fieldName": ":sid", "position": -1}]
    fields = matching.inventory_names(declared, city.columns, REGION_COLUMNS)
    rows = matching.enrich_inventory(city, reference(spark, "0001"), fields).orderBy("id").collect()
    assert [r.reference_matched for r in rows] == [True, False]
    assert rows[0].location == '{"type":"Point","coordinates":[1.0,2.0]}' and rows[0].ward_region_id == "5"
    assert rows[1].station_key is None and rows[1].unused is None and ":sid" not in rows[0].asDict()
    filled = {r.column_name: r.populated_rows for r in matching.populated_columns(
        matching.enrich_inventory(city, reference(spark, "0001"), fields)).collect()}
    assert filled["id"] == 2 and filled["unused"] == 0 and filled["ward_region_id"] == 1


def test_inventory_guards(spark):
    city = spark.createDataFrame([("0001",)], "id string")
    with pytest.raises(ValueError, match="claim one inventory id"):
        matching.enrich_inventory(city, reference(spark, "0001").unionByName(reference(spark, "0001")))
    with pytest.raises(ValueError, match="collide"):
        matching.enrich_inventory(city.withColumn("station_key", F.lit("x")), reference(spark))
    with pytest.raises(ValueError, match="share a header"):
        matching.enrich_inventory(city.withColumn("b", F.lit("x")), reference(spark), {"id": "id", "b": "id"})
    with pytest.raises(ValueError, match="occurs twice"):
        matching.enrich_inventory(city.unionByName(city), reference(spark))


def test_checks_raise(spark):
    bad = spark.createDataFrame([("a", 0), ("b", 2)], "check_name string, violations long")
    with pytest.raises(ValueError, match="b"):
        checks.require_all(bad)
    rows = spark.createDataFrame([("1", "41.9", "-87.6"), ("1", "95", "0"), ("2", "nan", "0")], "id string, la string, lo string")
    found = {r.check_name: r.violations for r in checks.feed_checks(rows, "f", "id", "la", "lo", page_size=3).collect()}
    assert found == {"f_not_empty": 0, "f_not_truncated": 1, "f_unique_ids": 1, "f_coordinates_in_range": 2}
