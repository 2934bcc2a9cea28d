"""Ranks within groups of any size without bringing a group to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_IN_BUCKET = 2048
BUCKETS_IN_BLOCK = 1024


def rank_within(df: DataFrame, groups: list[str], spread: str, order: list[str], total: int, out: str) -> DataFrame:
    """Add the 0-based rank ``out`` of each row in its group by ``spread``, then ``order``.

    ``spread`` is a double in [0, 1) over which the rows of a group lie evenly, so
    a group falls into buckets of bounded size: bucket counts give the rank at
    which a bucket starts, and rows are sorted only within theirs.  ``groups`` may
    be empty; their columns must not be null.
    """
    buckets = max(1, total // ROWS_IN_BUCKET)
    rows = df.withColumn("__bucket", F.floor(F.col(spread) * F.lit(float(buckets))).cast("long"))
    keys = [*groups, "__bucket"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__block", F.floor(F.col("__bucket") / BUCKETS_IN_BLOCK).cast("long"))
    blocks = counts.groupBy(*groups, "__block").agg(F.sum("__n").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*groups, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    inner = Window.partitionBy(*groups, "__block").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("__before", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    starts = within.join(blocks, [*groups, "__block"]).select(
        *keys, (F.col("__at") + F.col("__before")).alias("__start")
    )
    sorted_rows = rows.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(spread, *order)))
    ranked = sorted_rows.join(starts, keys)
    return ranked.withColumn(out, F.col("__start") + F.col("__row") - 1).drop("__bucket", "__row", "__start")


def seeded(seed: int, *columns: str):
    """A uniform double in [0, 1) from the MD5 of the seed and the columns as text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
