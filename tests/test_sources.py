from __future__ import annotations

import gzip
import hashlib
import json
from datetime import datetime
from pathlib import Path

import pytest
from fixtures import observation, observations
from pyspark.sql import functions as F

from placetrace.operators.observe import endpoints, observe
from placetrace.operators.profile import header_signatures
from placetrace.sources import feeds, integrity, tables, text_tables
from placetrace.sources.boundary import read_boundary
from placetrace.streaming.incremental import output_path, roll_up_new_files, trip_stream

MODERN = "ride_id,started_at,ended_at,start_station_name,start_station_id,end_station_name,end_station_id,start_lat,start_lng,end_lat,end_lng"
LEGACY = "trip_id,starttime,stoptime,from_station_id,from_station_name,to_station_id,to_station_name"


def write(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


def archive(root: Path) -> str:
    a = 'r1,2022-01-01 10:00,2022-01-01 10:05,"Elm ""A"", St",0012,Oak,13,41.9012,-87.6512,41.9112,-87.6612\n'
    write(root / "2022/trips.csv", "﻿" + MODERN + "\n" + a)
    legacy = LEGACY + "\n1,6/27/2013 10:00,6/27/2013 10:05,0012,Elm,13,Oak\n"
    (root / "2013").mkdir()
    (root / "2013/old.csv.gz").write_bytes(gzip.compress(legacy.encode()))
    write(root / "2013/stations.csv", "id,name,latitude,longitude,online date\n0012,Elm,41.9012,-87.6512,6/1/2013\n")
    write(root / "2013/.hidden.csv", "x\n")
    write(root / "__MACOSX/trips.csv", "x\n")
    return f"file:{root}"


def test_mixed_archive_is_read_as_text(spark, tmp_path):
    trips, catalog = text_tables.read_archive(spark, archive(tmp_path))
    rows = {r.trip_id: r for r in trips.collect()}
    assert set(rows) == {"r1", "1"}
    assert rows["r1"].start_station_name == 'Elm "A", St' and rows["r1"].start_station_id == "0012"
    assert (rows["r1"].archive, rows["r1"].member, rows["r1"].schema) == ("2022", "trips.csv", "modern")
    assert rows["1"].started_at == datetime(2013, 6, 27, 10) and rows["1"].start_lat is None
    listed = catalog.first()
    assert (listed.station_id, listed.reported_online_at) == ("0012", datetime(2013, 6, 1))
    skip = spark.createDataFrame([("2013", "old.csv.gz")], "archive string, member string")
    assert text_tables.read_archive(spark, f"file:{tmp_path}", skip=skip)[0].count() == 1


def test_malformed_record_fails(spark, tmp_path):
    write(tmp_path / "a/trips.csv", LEGACY + "\n1,2,3,4,5,6,7,8\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        text_tables.read_archive(spark, f"file:{tmp_path}")[0].collect()


def test_inventory_copies_and_manifest(spark, tmp_path):
    for name, text in {"a.csv": "x", "b.csv": "x", "c.csv": "y", "d.csv": "x", "note.txt": "z"}.items():
        write(tmp_path / name, text)
    root = f"file:{tmp_path}"
    kinds = {r.key: (r.bytes, r.is_data_table) for r in integrity.inventory(spark, root).collect()}
    assert kinds["a.csv"] == (1, True) and kinds["note.txt"] == (1, False)
    found = integrity.fingerprints(spark, root)
    order = spark.createDataFrame([(k, i) for i, k in enumerate(["a.csv", "b.csv", "c.csv", "d.csv"])], "key string, position long")
    copies = {r.key: r.duplicate_of for r in integrity.duplicates(found, order).collect()}
    assert copies == {"a.csv": None, "b.csv": "a.csv", "c.csv": None, "d.csv": "b.csv"}

    def manifest(**wrong):
        rows = []
        for path in tmp_path.iterdir():
            body = path.read_bytes()
            rows.append((path.name, len(body), hashlib.md5(body).hexdigest(), wrong.get(path.name[0], hashlib.sha256(body).hexdigest())))
        return spark.createDataFrame(rows, "key string, size long, etag string, sha256 string")

    assert integrity.require_integrity(spark, root, manifest()).count() == 5
    with pytest.raises(ValueError, match="wrong_sha256"):
        integrity.require_integrity(spark, root, manifest(c="0" * 64))


def test_feeds(spark, tmp_path):
    write(tmp_path / "city.json", json.dumps([{"id": "1", "station_name": "Elm", "latitude": "41.9", "longitude": "-87.6",
        "location": {"type": "Point", "coordinates": [-87.6, 41.9]}}, {"id": "2", "extra": 5}]))
    write(tmp_path / "info.json", json.dumps({"data": {"stations": [{"station_id": "u", "name": "Elm", "lat": 41.9, "lon": -87.6, "capacity": 7}]}}))
    write(tmp_path / "status.json", json.dumps({"data": {"stations": [{"station_id": "u", "is_installed": 1, "is_renting": 1, "is_returning": 0}]}}))
    write(tmp_path / "meta.json", json.dumps({"columns": [{"fieldName": "id", "name": "ID", "position": 1}]}))
    root = f"file:{tmp_path}"
    city = feeds.read_city(spark, f"{root}/city.json")
    assert city.count() == 2 and "extra" in city.columns and dict(city.dtypes)["latitude"] == "string"
    info = feeds.read_information(spark, f"{root}/info.json").first()
    assert (info.station_id, info.capacity, info.short_name) == ("u", 7, None)
    assert feeds.read_status(spark, f"{root}/status.json").first().is_returning == 0
    assert feeds.declared_columns(spark, f"{root}/meta.json") == [{"fieldName": "id", "name": "ID", "position": 1}]
    body = (tmp_path / "city.json").read_bytes()
    pins = {"sources": {"city": {"path": "city.json", "sha256": hashlib.sha256(body).hexdigest(), "retrieved_at": "2026-01-01"}}}
    write(tmp_path / "pins/manifest.json", json.dumps(pins))
    pinned = feeds.read_manifest(spark, f"{root}/pins/manifest.json")
    feeds.require_pinned(spark, root, pinned)
    with pytest.raises(ValueError, match="hash mismatch"):
        feeds.require_pinned(spark, root, pinned.withColumn("sha256", F.lit("not-the-hash")))


def test_boundary_file(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    body = {"features": [{"geometry": {"type": "Polygon", "coordinates": square}},
                         {"geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]}
    write(tmp_path / "b.geojson", json.dumps(body))
    edges = read_boundary(spark, f"file:{tmp_path}/b.geojson")
    assert edges.count() == 12 and edges.select("polygon").distinct().count() == 3


def test_sinks_and_reloads(spark, tmp_path):
    rows = [observation("0012", "Elm", 41.9, -87.6), observation(None, "Oak", archive="2013")]
    df = observations(spark, rows)
    tables.write_observations(df, f"file:{tmp_path}/obs")
    back = tables.read_observations(spark, f"file:{tmp_path}/obs", df.schema)
    assert {r.archive for r in back.collect()} == {"a.zip", "2013"}
    skip = spark.createDataFrame([("2013", "a.csv")], "archive string, member string")
    assert tables.read_observations(spark, f"file:{tmp_path}/obs", df.schema, skip).count() == 1
    fields = ["station_id", "station_name", "coordinate_inferred", "lat", "first_at"]
    tables.write_csv(df, f"file:{tmp_path}/csv", fields)
    lines = sorted("".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv")).split())
    text = " ".join(lines)
    assert "False" in text and "station_id,station_name,coordinate_inferred,lat,first_at" in text
    again = tables.read_csv(spark, f"file:{tmp_path}/csv",
        "station_id string, station_name string, coordinate_inferred boolean, lat double, first_at timestamp_ntz")
    got = {r.station_name: r for r in again.collect()}
    assert got["Elm"].station_id == "0012" and got["Oak"].station_id is None
    assert got["Elm"].first_at == datetime(2020, 1, 1) and got["Elm"].coordinate_inferred is False
    tables.write_json(df.select("station_id", "lat"), f"file:{tmp_path}/json")
    assert spark.read.json(f"file:{tmp_path}/json").count() == 2
    tables.publish({"published_rows": df})
    assert spark.sql("SELECT count(*) FROM published_rows").first()[0] == 2


MODERN_ROW = "{},2022-01-01 10:00:00,2022-01-01 10:05:00,7,Fir,8,Ash,41.91,-87.61,41.92,-87.62"


@pytest.mark.parametrize("bad", [MODERN_ROW.format("b") + ",extra", "b,2022-01-01 10:00:00"])
def test_every_action_on_a_malformed_file_fails(spark, tmp_path, bad):
    header = (
        "ride_id,started_at,ended_at,start_station_id,start_station_name,end_station_id,end_station_name,"
        "start_lat,start_lng,end_lat,end_lng"
    )
    write(tmp_path / "a/t.csv", "\n".join([header, MODERN_ROW.format("a"), bad]) + "\n")
    trips, _ = text_tables.read_archive(spark, f"file:{tmp_path}")
    for action in (
        lambda: trips.count(),
        lambda: trips.select("trip_id").collect(),
        lambda: endpoints(trips).select("role").count(),
        lambda: observe(trips).select("endpoint_count").collect(),
    ):
        with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
            action()
    stream = trip_stream(spark, str(tmp_path), tuple(header.split(",")))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        roll_up_new_files(stream, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()


def test_no_table_is_left_out(spark, tmp_path):
    row = LEGACY + "\n1,6/27/2013 10:00,6/27/2013 10:05,12,Elm,13,Oak\n"
    write(tmp_path / "a/A.CSV", row)
    write(tmp_path / "a/old.csv.bak", "not,a,table\n")
    with gzip.open(tmp_path / "a/b.csv.gz", "wt") as out:
        out.write(row)
    trips, _ = text_tables.read_archive(spark, f"file:{tmp_path}")
    assert {r.member for r in trips.select("member").collect()} == {"A.CSV", "b.csv.gz"}
    for name in ("c.xlsx", "d.csv.zip", "e.csv.GZ"):
        write(tmp_path / "a" / name, "x")
        with pytest.raises(ValueError, match="cannot be read"):
            text_tables.read_archive(spark, f"file:{tmp_path}")
        (tmp_path / "a" / name).unlink()


def test_new_files_are_rolled_up_once(spark, tmp_path):
    headers = tuple(LEGACY.split(","))
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    write(tmp_path / "in/2013/a.csv", LEGACY + "\n1,6/27/2013 10:00,6/27/2013 10:05,12,Elm,13,Oak\n")

    def run():
        roll_up_new_files(trip_stream(spark, source, headers), out, marks).awaitTermination()
        return {(r.archive, r.member, r.station_name, r.role): r.endpoint_count
                for r in spark.read.parquet(output_path(out)).collect()}

    first = run()
    assert len(first) == 2
    write(tmp_path / "in/2014/b.csv", LEGACY + "\n2,6/27/2014 10:00,6/27/2014 10:05,12,Elm,13,Oak\n" * 2)
    second = run()
    assert len(second) == 4 and first.items() <= second.items()
    assert run() == second


def test_header_signatures(spark):
    rows = [(["a"], "modern", None), (["b"], "legacy", None), (["a"], "modern", "x"), (["c"], "station_lookup", None)]
    df = spark.createDataFrame(rows, "headers array<string>, kind string, duplicate_of string")
    assert header_signatures(df).first()[0] == 2
