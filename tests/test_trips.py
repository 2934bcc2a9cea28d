from __future__ import annotations

from datetime import datetime, timedelta
from itertools import product

import numpy as np
import pytest
from fixtures import observation, observations
from pyspark.sql import functions as F

from placetrace.operators import names, normalize, observe, profile
from placetrace.operators.quantiles import grouped_quantiles

LEGACY = ["trip_id", "starttime", "stoptime", "from_station_id", "from_station_name", "to_station_id", "to_station_name"]
MODERN = ["ride_id", "started_at", "ended_at", "start_station_name", "start_station_id", "end_station_name",
          "end_station_id", "start_lat", "start_lng", "end_lat", "end_lng"]


def text_table(spark, headers, rows):
    df = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in headers))
    return df.withColumns({"archive": F.lit("a"), "member": F.lit("a.csv")})


LAYOUTS = ("%m/%d/%Y %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", None)


def test_dates_of_all_layouts(spark):
    """Every pair of layouts at both ends; None stands for text that is no date."""
    rows, expected = [], {"reversed_trips": 0, "invalid_start_time": 0, "invalid_end_time": 0}
    first, day = {}, datetime(2015, 11, 9, 8, 30)
    for i, (a, b) in enumerate(product(LAYOUTS, LAYOUTS)):
        start, end = day + timedelta(hours=i), day + timedelta(hours=i, minutes=7 if i % 3 else -7)
        texts = [t.strftime(layout) if layout else "soon" for t, layout in ((start, a), (end, b))]
        rows.append((f"t{i}", *texts, f"d{i % 4}", "Dock", f"e{i % 5}", "Exit"))
        expected["invalid_start_time"] += a is None
        expected["invalid_end_time"] += b is None
        if a and b:
            expected["reversed_trips"] += end < start
            if end >= start:
                for place, at in ((f"d{i % 4}", start), (f"e{i % 5}", end)):
                    first[place] = min(first.get(place, at), at)
    trips = normalize.normalize_trips(text_table(spark, LEGACY, rows))
    measures = profile.profile_trips(trips).first().asDict()
    assert measures["rows"] == len(rows) and {k: measures[k] for k in expected} == expected
    seen = {r.station_id: r.first_at for r in observe.observe(trips).collect() if r.first_at}
    assert seen == first


def test_only_precise_places_of_valid_trips_locate(spark):
    """Ends on the two-decimal grid give dates and a coarse place; reversed trips give neither."""
    rng = np.random.default_rng(12)
    precise = [(round(41.7712 + x, 6), round(-87.6634 + y, 6)) for x, y in rng.uniform(0, 0.002, (9, 2))]
    grid = [(41.77, -87.66), (41.78, -87.67), (41.77, -87.67)]
    rows, day = [], datetime(2019, 2, 1, 7)
    for i, (lat, lon) in enumerate([*grid, *precise, *precise]):
        back = i >= len(grid) + len(precise)  # the second time, the trip ends before it starts
        start, end = day + timedelta(days=-i if back else i), timedelta(minutes=-3 if back else 12)
        ends = (start.isoformat(sep=" "), (start + end).isoformat(sep=" "))
        rows.append((f"n{i}", *ends, "Lock", "L1", "Lock", "L1", str(lat), str(lon), str(lat), str(lon)))
    for row in observe.observe(normalize.normalize_trips(text_table(spark, MODERN, rows))).collect():
        assert row.lat == pytest.approx(np.median([p[0] for p in precise]))
        assert row.lon == pytest.approx(np.median([p[1] for p in precise]))
        assert row.coarse_lat == pytest.approx(np.median([g[0] for g in grid]))
        assert (row.coordinate_count, row.coarse_coordinate_count) == (len(precise), len(grid))
        assert row.valid_endpoint_count == len(grid) + len(precise) == row.endpoint_count - len(precise)
        assert row.first_trip_id == "n0"


def test_header_families(spark):
    verbose = ["01 - Rental Details Rental ID", "01 - Rental Details Local Start Time",
               "01 - Rental Details Local End Time", "03 - Rental Start Station ID",
               "03 - Rental Start Station Name", "02 - Rental End Station ID", "02 - Rental End Station Name"]
    row = ("1", "6/27/2013 10:00", "6/27/2013 10:05", "007", "A", "008", "B")
    a = text_table(spark, verbose, [row])
    b = text_table(spark, [h.replace("starttime", "start_time").replace("stoptime", "end_time") for h in LEGACY], [row])
    both = normalize.union_trips([a, b]).select("trip_id", "started_at", "start_station_id", "end_station_name")
    assert both.distinct().collect() == [("1", datetime(2013, 6, 27, 10), "007", "B")]
    with pytest.raises(ValueError, match="started_at"):
        normalize.resolve_headers(["trip_id"], normalize.TRIP_HEADERS)
    assert normalize.table_kind(["id", "name"]) == "station_lookup"
    assert normalize.table_kind(MODERN) == "modern"


def test_catalog_with_optional_dates(spark):
    df = spark.createDataFrame([("0012", " Elm ", "41.9", "-87.6", "6/1/2013")],
                               "id string, name string, latitude string, longitude string, `online date` string")
    row = normalize.normalize_catalog(df).first()
    assert (row.station_id, row.station_name, row.lat) == ("0012", "Elm", 41.9)
    assert row.reported_online_at == datetime(2013, 6, 1) and row.reported_created_at is None


def test_quantiles_match_numpy_with_a_hot_group(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": rng.normal(41.9, 0.05, 4000), "one": np.array([41.5]), "ties": np.repeat([41.6, 41.7], 7)}
    groups["hot"][:1500] = 41.9
    rows = [(g, "s", float(v)) for g, many in groups.items() for v in many] + [(None, "s", 42.0)]
    df = spark.createDataFrame(rows, "station_id string, series string, value double")
    df = df.withColumn("place", F.struct("station_id")).repartition(7)
    wanted = {"s": {"p05": 0.05, "mid": 0.5, "p95": 0.95}}
    for bucket in (1e-4, 0.5):
        got = {r.place.station_id: r for r in grouped_quantiles(df, "place", wanted, bucket).collect()}
        assert got[None].mid == 42.0
        for name, many in groups.items():
            for column, p in wanted["s"].items():
                assert got[name][column] == pytest.approx(np.quantile(many, p), abs=1e-9)


def test_months(spark):
    months = spark.createDataFrame([("2020-01", 3), ("2020-04", 1), ("2021-01", 2)], "month string, rows long")
    missing = {r.month for r in profile.month_gaps(months).collect()}
    assert len(missing) == 10 and "2020-02" in missing and "2020-04" not in missing
    assert {tuple(r) for r in profile.rows_by_year(months).collect()} == {("2020", 4), ("2021", 2)}


def test_name_recovery_needs_one_name_in_the_archive(spark):
    rows = [
        observation("12", None),
        observation("12", "Elm", role="end"),
        observation("13", None),
        observation("13", "Elm"),
        observation("13", "Oak"),
        observation(None, None),
        observation("14", "77"),
        observation("14", "Ash"),
        observation("12", None, archive="b.zip"),
    ]
    got = names.recover_names(observations(spark, rows)).collect()
    found = {(r.archive, r.station_id, r.original_station_name): (r.station_name, r.name_recovered) for r in got}
    assert found[("a.zip", "12", None)] == ("Elm", True)
    assert found[("a.zip", "13", None)] == (None, False)
    assert found[("a.zip", None, None)] == (None, False)
    assert found[("a.zip", "14", "77")] == ("Ash", True)
    assert found[("b.zip", "12", None)] == (None, False)


def test_exclusion_reasons(spark):
    rows = [
        observation("1", None, valid_endpoint_count=0),
        observation("1", None),
        observation("1", "12.5"),
        observation("1", "Elm"),
    ]
    reasons = [r.reason for r in names.with_exclusion(observations(spark, rows)).collect()]
    assert reasons == ["no_valid_trip_time", "missing_station_name", "numeric_placeholder_name", None]
