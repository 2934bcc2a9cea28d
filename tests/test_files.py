"""Files read on executors, the manifest, and refreshes of changing folders."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import os
import time
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placetrace.operators.observe import observe
from placetrace.sources import files, integrity, text_tables
from placetrace.streaming import incremental

LEGACY = "trip_id,starttime,stoptime,from_station_id,from_station_name,to_station_id,to_station_name"
ROW = "{},6/27/2013 10:00,6/27/2013 10:05,12,Elm,13,Oak\n"


def write(path, body, at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body if isinstance(body, bytes) else body.encode())
    if at is not None:
        os.utime(path, (at, at))


def test_a_long_file_is_hashed_in_blocks(tmp_path):
    path = tmp_path / "long.csv"
    with open(path, "wb") as out:
        out.truncate((2 << 30) + 12345)  # more than Spark takes as one value; sparse, so it needs no disk
    small = hashlib.sha256()
    for _ in range((2 << 30) >> 20):
        small.update(bytes(1 << 20))
    small.update(bytes(12345))
    size, _, sha = files.digests(f"file:{path}", block=1 << 20)
    assert (size, sha) == ((2 << 30) + 12345, small.hexdigest())


@pytest.mark.parametrize("name", ["data", "in (a)", "x+y", "50%"])
def test_keys_follow_the_whole_root(spark, tmp_path, name):
    root = tmp_path / name
    write(root / name / "y.csv", "one")
    write(root / "y.csv", "two")
    found = {r.key: r.sha256 for r in integrity.fingerprints(spark, str(root)).collect()}
    assert found == {f"{name}/y.csv": hashlib.sha256(b"one").hexdigest(), "y.csv": hashlib.sha256(b"two").hexdigest()}


def test_headers_of_all_codecs(spark, tmp_path):
    body = ("﻿" + LEGACY + "\r\n" + ROW.format(1) * 5000).encode()
    zstd = pa.BufferOutputStream()
    with pa.CompressedOutputStream(zstd, "zstd") as out:
        out.write(body)
    write(tmp_path / "a/plain.csv", body)
    write(tmp_path / "a/g.csv.gz", gzip.compress(body))
    write(tmp_path / "a/b.csv.bz2", bz2.compress(body))
    write(tmp_path / "a/z.csv.zst", zstd.getvalue().to_pybytes())
    write(tmp_path / "a/d.csv.deflate", zlib.compress(body))
    write(tmp_path / "a/quoted.csv", '"trip_id","a ""b"", c"\n')
    found = {r.member: r.headers for r in integrity.manifest(spark, str(tmp_path)).collect()}
    whole = LEGACY.split(",")
    assert all(found[m] == whole for m in ("plain.csv", "g.csv.gz", "b.csv.bz2", "z.csv.zst", "d.csv.deflate"))
    assert found["quoted.csv"] == ["trip_id", 'a "b", c']


def test_copies_are_left_out_and_only_equal_sizes_are_hashed(spark, tmp_path):
    write(tmp_path / "a/1.csv", LEGACY + "\n" + ROW.format(1))
    write(tmp_path / "b/2.csv", LEGACY + "\n" + ROW.format(1))
    write(tmp_path / "b/3.csv", LEGACY + "\n" + ROW.format(2))
    write(tmp_path / "c/4.csv", LEGACY + "\n" + ROW.format(1))
    write(tmp_path / "c/5.csv", LEGACY + "\n" + ROW.format(777))
    listed = {r.key: r for r in integrity.manifest(spark, str(tmp_path)).collect()}
    assert {k: r.duplicate_of for k, r in listed.items()} == {
        "a/1.csv": None, "b/2.csv": "a/1.csv", "b/3.csv": None, "c/4.csv": "b/2.csv", "c/5.csv": None}
    assert listed["c/5.csv"].sha256 is None and listed["b/3.csv"].sha256 is not None
    count = lambda **more: text_tables.read_archive(spark, str(tmp_path), **more)[0].count()
    assert count() == 3 and count(keep_copies=True) == 5


def rolled(spark, root, out):
    seen = incremental.current_observations(spark, str(out), str(root))
    return {(r.archive, r.member, r.station_name, r.role): r.endpoint_count for r in seen.collect()}


def test_refresh_follows_changes_copies_and_restarts(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    now = int(time.time()) - 1000
    write(root / "2013/a.csv", LEGACY + "\n" + ROW.format(1), now)
    write(root / "2013/B.Csv", LEGACY + "\n" + ROW.format(2) * 2, now)
    step = lambda: incremental.refresh(spark, str(root), str(out))
    assert step() == {"files": 2, "hashed": 2, "rolled_up": 2}
    first = rolled(spark, root, out)
    assert first[("2013", "a.csv", "Elm", "start")] == 1 and first[("2013", "B.Csv", "Oak", "end")] == 2
    assert step() == {"files": 2, "hashed": 0, "rolled_up": 0} and rolled(spark, root, out) == first
    # A copy adds nothing; a touched file is hashed again and not read.
    write(root / "2014/copy.csv", LEGACY + "\n" + ROW.format(1), now)
    os.utime(root / "2013/a.csv", (now + 5, now + 5))
    assert step() == {"files": 3, "hashed": 2, "rolled_up": 0}
    assert sum(rolled(spark, root, out).values()) == sum(first.values())
    # New content under an old path replaces its roll-up.
    write(root / "2013/a.csv", LEGACY + "\n" + ROW.format(1) * 3, now + 9)
    assert step()["rolled_up"] == 1
    second = rolled(spark, root, out)
    assert second[("2013", "a.csv", "Elm", "start")] == 3 and second[("2014", "copy.csv", "Elm", "start")] == 1
    # A file that is gone goes; a refresh that broke off before its state is repeated.
    (root / "2013/B.Csv").unlink()
    step()
    third = rolled(spark, root, out)
    assert not any(member == "B.Csv" for _, member, _, _ in third)
    last = max((out / f"rules={incremental.RULE_VERSION}/state").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    (last / "_SUCCESS").unlink()
    step()
    assert rolled(spark, root, out) == third


def test_the_stream_reads_what_the_batch_reads(spark, tmp_path):
    for name in ("A.csv", "B.Csv", "E.CSV"):
        write(tmp_path / "in/x" / name, LEGACY + "\n" + ROW.format(name))
    write(tmp_path / "in/x/C.CSV.gz", gzip.compress((LEGACY + "\n" + ROW.format("C")).encode()))
    write(tmp_path / "in/x/d.csv.bak", "no table")
    stream = incremental.trip_stream(spark, str(tmp_path / "in"), tuple(LEGACY.split(",")))
    incremental.roll_up_new_files(stream, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    rows = spark.read.parquet(incremental.output_path(str(tmp_path / "out")))
    trips, _ = text_tables.read_archive(spark, str(tmp_path / "in"))
    batch = {r.member for r in observe(trips).select("member").collect()}
    assert {r.member for r in rows.select("member").collect()} == batch == {"A.csv", "B.Csv", "E.CSV", "C.CSV.gz"}
    write(tmp_path / "in/x/f.xlsx", "x")
    with pytest.raises(ValueError, match="cannot be read"):
        incremental.trip_stream(spark, str(tmp_path / "in"), tuple(LEGACY.split(",")))


def test_files_are_dealt_out_one_by_one(spark, tmp_path):
    for i in range(30):
        write(tmp_path / f"{i}.csv", str(i))
    found = files.each_file(files.listing(spark, str(tmp_path)), files.digests, integrity.DIGESTS)
    assert found.rdd.getNumPartitions() == 30
    assert found.agg(F.sum("size")).first()[0] == sum(len(str(i)) for i in range(30))
