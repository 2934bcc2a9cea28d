"""Connected components by alternating large-star and small-star rounds, and groups inside partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.llm.tables import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long); root is the smallest node reachable.

    Each round needs only minima per node, so a node of any degree is combined on
    the map side; rounds grow with the logarithm of the longest path.
    """
    a, b = F.col("a"), F.col("b")
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    pairs = stored(pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = _state(pairs)
    if not state[0]:  # no edges, nothing to settle
        return pairs.toDF("node", "root")
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        least = stored(least)  # apart from its aggregate, the join with a node of many edges can be split
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large.where("a != b"))
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(pairs)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _state(pairs):
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def by_key(batches, key):
    """Tables of equal ``key`` from batches sorted by it; a group may cross batches."""
    kept = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        kept = part if kept is None else pa.concat_tables([kept, part])
        values = kept.column(key).to_numpy()
        if not len(values):
            continue
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        start = 0
        for cut in cuts.tolist():
            yield kept.slice(start, cut - start)
            start = cut
        kept = kept.slice(start)
    if kept is not None and kept.num_rows:
        yield kept


class Union:
    """Sets of positions, merged."""

    def __init__(self, n):
        self.of = list(range(n))

    def find(self, x):
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.of[max(x, y)] = min(x, y)
        return True
