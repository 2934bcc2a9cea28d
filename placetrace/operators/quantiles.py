"""Exact interpolated quantiles per group that survive a group of any size."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Degrees per bucket: a group spans a bounded box, so it has a bounded number
# of buckets, and a bucket holds only the distinct values within some metres.
BUCKET = 1e-4


def _ranks(total: Column, p: float) -> tuple[Column, Column, Column]:
    position = (total - 1) * F.lit(float(p))
    low = F.floor(position)
    return low, F.ceil(position), position - low


def _holds(low_edge: Column, high_edge: Column, rank: Column) -> Column:
    return (rank >= low_edge) & (rank < high_edge)


def interpolated(chosen: Column, value: Column, start: Column, end: Column, total: Column, p: float) -> Column:
    """Aggregate: the ``p`` quantile of the chosen rows, each of which holds the ranks [start, end) of ``total``."""
    low, high, fraction = _ranks(total, p)
    at_low = F.max(F.when(chosen & _holds(start, end, low), value))
    at_high = F.max(F.when(chosen & _holds(start, end, high), value))
    return at_low + (at_high - at_low) * F.max(F.when(chosen, fraction))


def of_sorted(values: Column, p: float) -> Column:
    """The ``p`` quantile of a sorted array, interpolated alike; NULL of an empty one."""
    low, high, fraction = _ranks(F.size(values), p)
    at_low, at_high = (F.get(values, rank.cast("int")) for rank in (low, high))
    return at_low + (at_high - at_low) * fraction


def grouped_quantiles(
    values: DataFrame,
    key: str,
    wanted: Mapping[str, Mapping[str, float]],
    bucket: float = BUCKET,
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles of several value series at once.

    ``values`` has the key, ``series`` (text) and ``value`` (double); ``wanted``
    maps output columns to a probability, per series.  A key of several columns
    is given as one struct, in which NULL fields compare as equal.  The built-in
    ``percentile`` ships a map of all values of a group to one task, which a hot
    group breaks.  Here equal values are combined before the first shuffle,
    ranks are located in bucket totals, and only the buckets that hold a wanted
    rank are sorted - each on its own.  With ``weight``, a row stands for so many.
    """
    group = [key, "series"]
    counted = (
        values.filter(F.col("value").isNotNull())
        .groupBy(*group, F.floor(F.col("value") / bucket).alias("bucket"), "value")
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    )
    running = Window.partitionBy(*group).orderBy("bucket")
    totals = (
        counted.groupBy(*group, "bucket")
        .agg(F.sum("n").alias("held"))
        .withColumn("upto", F.sum("held").over(running))
        .withColumn("total", F.sum("held").over(Window.partitionBy(*group)))
        .withColumn("before", F.col("upto") - F.col("held"))
    )

    total = F.col("total")
    probabilities = [
        (series, column, p) for series, named in wanted.items() for column, p in named.items()
    ]

    def any_rank(low_edge: Column, high_edge: Column) -> Column:
        hits = []
        for series, _, p in probabilities:
            low, high, _frac = _ranks(total, p)
            hit = _holds(low_edge, high_edge, low) | _holds(low_edge, high_edge, high)
            hits.append((F.col("series") == series) & hit)
        return reduce(lambda a, b: a | b, hits)

    needed = totals.filter(any_rank(F.col("before"), F.col("upto"))).select(
        *group, "bucket", "before", "total"
    )
    inside = Window.partitionBy(*group, "bucket").orderBy("value")
    ranked = (
        counted.join(needed, [*group, "bucket"])
        .withColumn("end", F.col("before") + F.sum("n").over(inside))
        .withColumn("start", F.col("end") - F.col("n"))
        .filter(any_rank(F.col("start"), F.col("end")))
    )
    picks = [
        interpolated(F.col("series") == series, F.col("value"), F.col("start"), F.col("end"), total, p).alias(column)
        for series, column, p in probabilities
    ]
    return ranked.groupBy(key).agg(*picks)
