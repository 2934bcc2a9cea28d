from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from placetrace.functions import geo, rules, text, times
from placetrace.params import Rules


def values(spark, column, rows, schema="v string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_names(spark):
    names = ["  Elm St   & First Ave (*) ", "Elm St & First Ave (Temp)", "Public Rack - Elm N", None, "   "]
    assert values(spark, text.normalize_name(F.col("v")), names) == [
        "elm st & first ave",
        "elm st & first ave",
        "public rack - elm n",
        "",
        "",
    ]
    assert values(spark, text.display_name(F.col("v")), ["Elm (TEMP)", "Elm (*) N"]) == ["Elm", "Elm (*) N"]
    assert values(spark, text.clean(F.col("v")), [" a \t b ", "  ", None]) == ["a b", None, None]
    assert values(spark, text.is_placeholder(F.col("v")), ["12.5", "12a", ""]) == [True, False, False]


def test_timestamps(spark):
    given = [
        "2013-06-27 10:00:01", "2013-06-27T10:00", "6/27/2013 9:05", "6/27/2013 9:05:07", "6/27/2013",
        "6/27/13 9:05", "2013", "2013-06", "broken", "13/40/2013 1:00", None,
    ]
    day = datetime(2013, 6, 27)
    assert values(spark, times.parse_timestamp(F.col("v")), given) == [
        datetime(2013, 6, 27, 10, 0, 1), datetime(2013, 6, 27, 10), datetime(2013, 6, 27, 9, 5),
        datetime(2013, 6, 27, 9, 5, 7), day, datetime(2013, 6, 27, 9, 5), None, None, None, None, None,
    ]


def test_doubles(spark):
    assert values(spark, times.parse_double(F.col("v")), ["41.9", " -87 ", "41.9d", "1e3", "x", ""]) == [
        41.9, -87.0, None, 1000.0, None, None,
    ]


def test_distance_and_cells(spark):
    df = spark.createDataFrame([(41.9, -87.6, 41.901, -87.6)], "a double, b double, c double, d double")
    metres = df.select(geo.haversine(*[F.col(c) for c in "abcd"])).first()[0]
    assert metres == pytest.approx(111.195, abs=0.01)
    cells = spark.createDataFrame(
        [(41.90, -87.65, 0, 41.904, -87.646), (41.90, -87.65, 0, 41.8, -87.65), (None, None, 0, 0.0, 0.0),
         (41.90, -87.65, 3, 41.8, -87.65)],
        "a double, b double, n long, c double, d double",
    )
    inside = geo.coarse_cell_contains(*[F.col(c) for c in "abncd"])
    assert [r[0] for r in cells.select(inside).collect()] == [True, False, True, True]
    grid = spark.createDataFrame([(41.9, -87.65), (41.901, -87.65), (None, 1.0)], "a double, b double")
    assert [r[0] for r in grid.select(geo.is_coarse(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_classes(spark):
    rows = [("elm st", ["1"]), ("public rack - elm", ["1"]), ("elm", ["TESTING"]), ("base", []), ("baseline", [])]
    df = spark.createDataFrame(rows, "k string, ids array<string>")
    got = [r[0] for r in df.select(text.entity_class(F.col("k"), F.col("ids"))).collect()]
    assert got == ["station", "public_rack", "operational", "operational", "station"]
    branded = Rules(extra_operational_words=("acme mobile",))
    df = spark.createDataFrame([("acme mobile 3", [])], "k string, ids array<string>")
    assert df.select(text.entity_class(F.col("k"), F.col("ids"), branded)).first()[0] == "operational"


def test_rules(spark):
    rows = [(True, True, True, 10.0), (True, False, True, 149.0), (False, True, True, 30.0),
            (False, True, True, 40.0), (True, True, False, 1.0), (True, True, True, None)]
    df = spark.createDataFrame(rows, "n boolean, i boolean, c boolean, m double")
    rank = rules.match_rank(*[F.col(c) for c in "nicm"])
    assert [r[0] for r in df.select(rank).collect()] == [0, 1, 2, 99, 99, 99]
    assert values(spark, rules.tidy_flags(F.col("v")), ["b | a | b |  ", ""]) == ["a | b", ""]
    reasons = rules.date_review_reasons(F.lit(None), F.col("v"))
    assert values(spark, reasons, ["first_archive_day | possible_rename", None]) == [
        "possible_rename | first_archive_day", "",
    ]
