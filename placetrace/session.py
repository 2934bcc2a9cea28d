"""Session helpers: durable checkpoints and a local session for tests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("placetrace")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which a cluster must name and share.

    Only a local session without ``spark.checkpoint.dir`` gets a temporary one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="placetrace-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


# Compressed bytes of a scan task, and shuffle partitions before Spark joins small ones.
SPLIT_BYTES = 16 << 20
FINE_PARTITIONS = 512
# Rows of a file of such a step; a split never cuts a row group.
FILE_ROWS = 1_000_000
# Bytes of files whose rows a step may broadcast: compressed, and before rows are copied to cells, they
# tell little of what the driver would hold.
BROADCAST_BYTES = 256 << 10
# Spark removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """While it lasts, the session has these settings."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Settings of a step that is written.

    Joins are planned with broadcasts of small files only; larger sides may be broadcast
    once they are shuffled, up to the size that the session allows, as that is their size
    in memory.  Shuffle files go when the step ends.
    """
    allowed = spark.conf.get(BROADCAST)
    text = allowed.strip().lower().removesuffix("b")
    power = "kmgtp".find(text[-1]) + 1
    size = int(text[:-1] if power else text) << 10 * power
    measured = spark.conf.get(MEASURED, None) or allowed
    with settings(spark, {CLEANUP: "true", BROADCAST: str(min(BROADCAST_BYTES, size)), MEASURED: measured}):
        yield


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """While it lasts, the session cuts scans and shuffles so finely that tasks sort in memory.

    A few bytes of a compressed file make a row of hundreds: the usual splits give
    tasks that grow with the table until their sorts spill.
    """
    fine = {
        "spark.sql.files.maxPartitionBytes": str(SPLIT_BYTES),
        "spark.sql.shuffle.partitions": str(max(FINE_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))),
    }
    if spark.conf.get("spark.sql.adaptive.enabled") != "true":  # nothing would join small partitions again
        del fine["spark.sql.shuffle.partitions"]
    with settings(spark, fine):
        yield


def checkpoint(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Cut the lineage of ``df``: write it to the checkpoint folder and read it back.

    The written table survives the loss of executors.  Unlike the result of
    ``DataFrame.checkpoint`` it has the true size, by which Spark chooses joins,
    and it does not carry the constraints of the old plan, which multiply from
    round to round in iterative jobs.  ``file_rows`` bounds the rows of a file.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    with writing(spark):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_large(df: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """``checkpoint`` for steps over whole tables: written, and later read, in tasks of bounded size."""
    with small_tasks(df.sparkSession):
        return checkpoint(df, file_rows)
