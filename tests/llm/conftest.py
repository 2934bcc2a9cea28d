from __future__ import annotations

import pytest
from pyspark.sql import types as T

DATA = "/root/testdata/sf0.001"

ODD = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("rep", T.StringType()),
        T.StructField("node", T.LongType()),
        T.StructField("label", T.IntegerType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(60000))
    same = "one two three four five six seven eight nine ten " * 6
    rows = [
        (1, same, "en", "a", 300, "x", 1, 1),
        (2, same, "en", "a", 300, "x", 1, 1),
        (2, same, "en", "a", 300, "x", 1, 1),
        (3, "", "en", None, 0, None, None, None),
        (4, None, None, "a", None, None, None, None),
        (5, " \n\t ", "en", "b", 4, "y", 2, 0),
        (6, long_text, "en", "b", len(long_text), "y", 2, 0),
        (None, same, None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None),
        (7, "short", "en", "c", 5, "z", 3, 0),
        (8, "Ünïcödé texte “quoted” " * 20, "fr", "c", 400, "z", 3, 0),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD)
