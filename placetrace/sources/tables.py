"""Sinks and typed reloads of the published tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def write_observations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by archive.  ``rebalance`` evens out files and splits a large archive."""
    df.hint("rebalance", "archive").write.mode(mode).option("compression", "zstd").partitionBy(
        "archive"
    ).parquet(path)


def read_observations(
    spark: SparkSession, path: str, schema: StructType | None = None, skip: DataFrame | None = None
) -> DataFrame:
    """Observations without those of files that copy earlier ones.

    The archive stays text, so the partition type is given, not inferred.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(path).withColumn("archive", F.col("archive").cast("string"))
    if skip is None:
        return rows
    return rows.join(skip.select("archive", "member"), ["archive", "member"], "left_anti")


def _cell(df: DataFrame, field: str) -> Column:
    kind = df.schema[field].dataType.typeName()
    if kind == "boolean":
        return F.when(F.col(field), "True").when(~F.col(field), "False").alias(field)
    if kind in ("struct", "array", "map"):
        return F.to_json(field).alias(field)
    return F.col(field)


def write_csv(df: DataFrame, path: str, fields: Sequence[str] | None = None) -> None:
    """Header row, fixed field order, other columns ignored, NULL as a blank cell."""
    chosen = list(fields or df.columns)
    df.select(*[_cell(df, f) for f in chosen]).write.mode("overwrite").options(
        header=True, nullValue="", emptyValue="", quote='"', escape='"',
        timestampNTZFormat=TIMESTAMP_FORMAT, timestampFormat=TIMESTAMP_FORMAT,
    ).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed reload; id columns are text because the schema says so."""
    return (
        spark.read.schema(schema)
        .options(
            header=True, mode="FAILFAST", quote='"', escape='"',
            timestampNTZFormat=TIMESTAMP_FORMAT, timestampFormat=TIMESTAMP_FORMAT,
        )
        .csv(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def publish(tables: Mapping[str, DataFrame], database: str | None = None) -> None:
    """Named tables: saved into ``database``, or temporary views without one."""
    for name, df in tables.items():
        if database is None:
            df.createOrReplaceTempView(name)
        else:
            df.write.mode("overwrite").option("compression", "zstd").saveAsTable(f"{database}.{name}")
