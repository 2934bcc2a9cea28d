"""Delimited text tables of mixed header families, read strictly as text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from placetrace.operators.normalize import normalize_catalog, normalize_trips, table_kind
from placetrace.sources.integrity import manifest


@dataclass(frozen=True)
class TextTable:
    """Files that share one header row."""

    headers: tuple[str, ...]
    paths: tuple[str, ...]

    @property
    def kind(self) -> str:
        return table_kind(self.headers)


def group_by_header(listed: DataFrame) -> list[TextTable]:
    """The files of a manifest grouped by header row; one read per group keeps columns in place.

    One row per header row comes to the driver, with the paths that its reader takes.
    """
    groups = listed.groupBy("headers").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect()
    return [TextTable(tuple(row.headers), tuple(row.paths)) for row in sorted(groups, key=lambda row: row.paths[0])]


def read_text_table(spark: SparkSession, table: TextTable, multi_line: bool = False) -> DataFrame:
    """All columns as text, with ``archive`` (folder) and ``member`` (file).

    Any malformed record fails every action on the rows, also one of few columns.  Files are split over tasks unless
    ``multi_line`` is set, which quoted line breaks need; without it such a
    record fails instead of being misread.
    """
    schema = StructType([StructField(h, StringType()) for h in table.headers])
    rows = (
        spark.read.schema(schema)
        .options(
            header=True,
            mode="FAILFAST",
            columnPruning=False,  # with it, records are checked in the wanted columns only
            quote='"',
            escape='"',
            enforceSchema=False,
            multiLine=multi_line,
            encoding="UTF-8",
        )
        .csv(list(table.paths))
    )
    return with_lineage(rows)


def with_lineage(rows: DataFrame) -> DataFrame:
    steps = F.split(F.url_decode(F.col("_metadata.file_path")), "/")
    return rows.select(
        "*", F.element_at(steps, -2).alias("archive"), F.element_at(steps, -1).alias("member")
    )


def read_archive(
    spark: SparkSession,
    root: str,
    multi_line: bool = False,
    skip: DataFrame | None = None,
    listed: DataFrame | None = None,
    keep_copies: bool = False,
) -> tuple[DataFrame | None, DataFrame | None]:
    """(trips, catalog) of everything below ``root``; either may be None.

    Files that copy earlier ones are left out unless ``keep_copies`` is set.
    ``listed`` is the manifest of ``root``, if it has been made already; ``skip``
    lists (archive, member) of further files to leave out.
    """
    listed = manifest(spark, root) if listed is None else listed
    if not keep_copies:
        listed = listed.filter("duplicate_of IS NULL")
    if skip is not None:
        listed = listed.join(skip.select("archive", "member"), ["archive", "member"], "left_anti")
    trips: DataFrame | None = None
    catalog: DataFrame | None = None
    for table in group_by_header(listed):
        rows = read_text_table(spark, table, multi_line)
        if table.kind == "station_lookup":
            part = normalize_catalog(rows)
            catalog = part if catalog is None else catalog.unionByName(part)
        else:
            part = normalize_trips(rows)
            trips = part if trips is None else trips.unionByName(part)
    return trips, catalog
