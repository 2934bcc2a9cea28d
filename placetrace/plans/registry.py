"""Where registered queries and their checking SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrace.plans import oracle_parts as o
from placetrace.plans.stages import Stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build: Callable[[Stages], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Stages(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = o.query(sql)
        return build

    return add


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({name: F.round(name, n) for name, n in places.items()})
