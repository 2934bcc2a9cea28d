"""Roll-ups kept up to date as trip files arrive, change or go.

``refresh`` keeps a state beside the roll-ups: which content every file has.  A
roll-up belongs to a content and never changes, so a file that is replaced under
its path points to another roll-up, a copy adds nothing, and work that is repeated
after a failure writes the same partition again.  ``current_observations`` reads
the roll-ups of the files that are there, each content once.

``roll_up_new_files`` is the file stream over the same roll-up, for folders to
which files are only added: a file is read in one micro-batch and its observations
replace the partition of that file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from placetrace.operators.members import is_data_table, is_readable_table
from placetrace.operators.normalize import normalize_trips
from placetrace.operators.observe import observe
from placetrace.params import DEFAULT, Rules
from placetrace.session import checkpoint as written
from placetrace.sources import files, integrity
from placetrace.sources.text_tables import group_by_header, read_text_table, with_lineage

# Part of the output path: another version starts from scratch.
RULE_VERSION = 2
# Every table that the batch reader can decode: the end in any case, the codec in small letters.
READABLE = "*.[cC][sS][vV]{,.gz,.bz2,.zst,.lz4,.deflate,.snappy}"
STATE = "key string, bytes long, modified timestamp, content string, headers array<string>, kind string"
PLACE = ("archive", "member")


def require_readable(spark: SparkSession, folder: str) -> None:
    """Raise when a data table below ``folder`` cannot be decoded, as the batch reader does."""
    listed = files.listing(spark, folder).filter(is_data_table(F.col("path")) & ~is_readable_table(F.col("path")))
    bad = listed.orderBy("path").limit(5).collect()
    if bad:
        raise ValueError(f"some data tables cannot be read, such as {[row.path for row in bad]}")


def trip_stream(
    spark: SparkSession, folder: str, headers: tuple[str, ...], max_files: int = 1000
) -> DataFrame:
    """Text trips of one header family as they arrive under ``folder``/archive/."""
    require_readable(spark, folder)
    schema = StructType([StructField(h, StringType()) for h in headers])
    rows = (
        spark.readStream.schema(schema)
        .options(
            header=True, mode="FAILFAST", quote='"', escape='"', enforceSchema=False,
            columnPruning=False, maxFilesPerTrigger=max_files, recursiveFileLookup=True,
            pathGlobFilter=READABLE,
        )
        .csv(folder)
    )
    return with_lineage(rows)


def output_path(root: str) -> str:
    return f"{root.rstrip('/')}/rules={RULE_VERSION}"


def _write(observations: DataFrame, parts: tuple[str, ...], target: str) -> None:
    (
        observations.hint("rebalance", *parts)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*parts)
        .parquet(target)
    )


def roll_up_new_files(
    stream: DataFrame, output: str, checkpoint: str, rules: Rules = DEFAULT
) -> StreamingQuery:
    """Starts the roll-up of everything that has arrived; ends when it is done."""
    target = output_path(output)

    def write(batch: DataFrame, _: int) -> None:
        _write(observe(normalize_trips(batch), rules=rules), PLACE, target)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete state tables: those that their job has marked as done."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")
    found = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(location)
    return sorted(int(status.getPath().getParent().getName().split("=")[1]) for status in found or [])


def state(spark: SparkSession, output: str) -> tuple[int, DataFrame]:
    """(version, files with their content) of the last complete refresh; version 0 is empty."""
    folder = f"{output_path(output)}/state"
    versions = _versions(spark, folder)
    if not versions:
        return 0, spark.createDataFrame([], STATE)
    return versions[-1], spark.read.schema(STATE).parquet(f"{folder}/version={versions[-1]}")


def refresh(spark: SparkSession, root: str, output: str, rules: Rules = DEFAULT) -> dict[str, int]:
    """Bring the roll-ups of all trip files below ``root`` up to date.

    Only files whose size or time differs from the state are hashed, and only
    contents without a roll-up are read.  Returns how many files are there, were
    hashed, and were rolled up.  The state is written last, under a number of its
    own, so a refresh that breaks off is repeated by the next one.
    """
    require_readable(spark, root)
    target = output_path(output)
    version, before = state(spark, output)
    listed = written(files.listing(spark, root).filter(is_data_table(F.col("path"))))
    same = ["key", "bytes", "modified"]
    fresh = written(listed.join(before, same, "left_anti"))
    hashed = files.each_file(fresh, files.digests, integrity.DIGESTS).drop("size", "md5")
    hashed = written(integrity.with_headers(spark, written(hashed.withColumnRenamed("sha256", "content"))))
    kept = before.join(listed.select(*same), same, "left_semi")
    columns = [field.split()[0] for field in STATE.split(", ")]
    now = written(kept.unionByName(hashed.select(*columns)))
    # One file stands for each new content; contents of the state are rolled up already.
    todo = hashed.filter("kind <> 'station_lookup'").join(before.select("content").distinct(), "content", "left_anti")
    todo = written(todo.groupBy("content", "headers", "kind").agg(F.min("path").alias("path")))
    for table in group_by_header(todo):
        rows = normalize_trips(read_text_table(spark, table))
        lineage = todo.select("content", *_place(F.col("path")))
        seen = observe(rows, rules=rules).join(lineage, list(PLACE)).drop(*PLACE)
        _write(seen, ("content",), f"{target}/contents")
    now.write.mode("overwrite").parquet(f"{target}/state/version={version + 1}")
    return {"files": now.count(), "hashed": fresh.count(), "rolled_up": todo.count()}


def _place(path):
    steps = F.split(path, "/")
    return F.element_at(steps, -2).alias("archive"), F.element_at(steps, -1).alias("member")


def current_observations(spark: SparkSession, output: str, root: str) -> DataFrame:
    """Observations of the files of the last refresh of ``root``; copies of a content count once, for the first key."""
    _, files_now = state(spark, output)
    base = files.qualified(spark, root)
    owners = (
        files_now.filter("kind <> 'station_lookup'")
        .groupBy("content")
        .agg(F.min("key").alias("key"))
        .select("content", *_place(F.concat(F.lit(f"{base}/"), "key")))
    )
    seen = spark.read.parquet(f"{output_path(output)}/contents").withColumn("content", F.col("content").cast("string"))
    return seen.join(owners, "content").drop("content")
