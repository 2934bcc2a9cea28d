"""Files below a root: their keys, and reading them on executors block by block.

A listing names every file; what must be read of it is read by the tasks, in
blocks of bounded size, so a file of any length passes through little memory.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import hashlib
import zlib
from collections.abc import Callable
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 8 << 20
# Most files that one job hands out one by one.
TASKS = 4096
# Their blocks are framed by Hadoop, so the file system of the driver decodes the first line.
FRAMED = (".lz4", ".snappy")


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` with the scheme and authority of its file system, as paths of listed files have them."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(root)
    filesystem = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return filesystem.makeQualified(location).toString().rstrip("/")


def key_below(spark: SparkSession, root: str):
    """The path of a file below ``root``: what follows the whole qualified root, whatever its name holds."""
    base = qualified(spark, root)
    return F.expr(f"substring(path, {len(base) + 2})")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(key, path, bytes, modified) of every file that holds a byte; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.select(
        key_below(spark, root).alias("key"),
        "path",
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )


def open_input(path: str):
    """A binary stream of a file, on any machine that sees its store."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1), safe=":/@"))
    return store.open_input_stream(inner)


def digests(path: str, block: int = BLOCK) -> tuple[int, str, str]:
    """(bytes, md5, sha256) of one file, a block at a time."""
    size, md5, sha = 0, hashlib.md5(), hashlib.sha256()
    with open_input(path) as stream:
        while part := stream.read(block):
            size += len(part)
            md5.update(part)
            sha.update(part)
    return size, md5.hexdigest(), sha.hexdigest()


class _Inflated:
    def __init__(self, stream):
        self.stream, self.inflater = stream, zlib.decompressobj()

    def read(self, size):
        part = self.stream.read(size)
        return self.inflater.decompress(part) if part else b""


def _decoded(stream, path: str):
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "gz":
        return gzip.GzipFile(fileobj=stream)
    if suffix == "bz2":
        return bz2.BZ2File(stream)
    if suffix == "zst":
        return pa.CompressedInputStream(stream if isinstance(stream, pa.NativeFile) else pa.PythonFile(stream), "zstd")
    return _Inflated(stream) if suffix == "deflate" else stream


def header_of(line: str) -> list[str]:
    return next(csv.reader([line.removeprefix("﻿")]), [])


def read_header(path: str, block: int = 1 << 16) -> list[str]:
    """The header row of one delimited file; only its first line is decoded."""
    with open_input(path) as raw:
        stream, line = _decoded(raw, path), b""
        while b"\n" not in line and b"\r" not in line and (part := stream.read(block)):
            line += part
    return header_of(line.split(b"\n")[0].split(b"\r")[0].decode("utf-8"))


def driver_header(spark: SparkSession, path: str) -> list[str]:
    """The header row through the file system of the path; for the codecs of ``FRAMED``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    location = jvm.org.apache.hadoop.fs.Path(path)
    stream = location.getFileSystem(conf).open(location)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(location)
        source = codec.createInputStream(stream) if codec is not None else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8"))
        return header_of(reader.readLine() or "")
    finally:
        stream.close()


def each_file(files: DataFrame, read: Callable[[str], tuple], schema: str) -> DataFrame:
    """``files`` (path and others) with what ``read`` returns for each path; files are dealt out over tasks.

    The number of tasks is given, so that adaptive plans do not join the short
    rows of long files into one task.
    """
    spark = files.sparkSession
    count = files.count()
    names = [f.split()[0] for f in schema.split(", ")]
    kept = files.columns
    types = {f.name: f.dataType.simpleString() for f in files.schema}
    out = ", ".join([*[f"`{c}` {types[c]}" for c in kept], schema])
    fields = spark.createDataFrame([], schema).toArrow().schema

    def run(batches):
        for batch in batches:
            rows = [read(path) for path in batch.column("path").to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            added = [pa.array(list(c), fields.field(n).type) for c, n in zip(columns, names, strict=True)]
            yield pa.record_batch([*batch.columns, *added], names=[*kept, *names])

    return files.repartition(max(1, min(TASKS, count)), "path").mapInArrow(run, out)
