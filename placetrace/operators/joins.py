"""Join helpers: null-safe keys, unique right sides, split hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetrace.session import checkpoint

# Rows of one key that a single task may pair with the other side.
PAIR_BLOCK = 2048


# Key columns that may be NULL; lineage, role and generated keys never are.
NULLABLE = frozenset({"station_id", "station_name", "original_station_name"})


def join_null_safe(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    nullable: frozenset[str] = NULLABLE,
) -> DataFrame:
    """Equi-join where NULL equals NULL in the nullable keys; right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})

    def same(key: str) -> Column:
        a, b = F.col(key), F.col(f"__{key}")
        return a.eqNullSafe(b) if key in nullable else a == b

    condition = reduce(lambda a, b: a & b, [same(k) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def join_needed(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    needed: Column,
    nullable: frozenset[str] = NULLABLE,
) -> DataFrame:
    """``join_null_safe`` of the left rows that need it; the others get NULLs and are not moved.

    ``right`` has one row per key.
    """
    needed = F.coalesce(needed, F.lit(False))
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in keys]
    asked = join_null_safe(left.filter(needed), right, keys, nullable=nullable)
    return asked.unionByName(left.filter(~needed).select("*", *added))


def hot_counts(df: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """Keys with more than ``block`` rows, and into how many blocks to split them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counts.filter(F.col("__n") > block).select(
        *keys, F.ceil(F.col("__n") / block).cast("int").alias("__blocks")
    )


def with_blocks(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    joined = df.join(hot, list(keys), "left")
    return joined.withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt by ``keys`` over all shuffle partitions, for a join that must not be broadcast.

    Rows that are copied before a join, or that a file holds in a few bytes each, are
    far larger in memory than the files by which Spark chooses broadcasts and tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).hint("merge")


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    row_id: Sequence[str],
    condition: Column | None = None,
    block: int = PAIR_BLOCK,
    right_id: Sequence[str] | None = None,
    shuffled: bool = False,
) -> DataFrame:
    """Inner equi-join whose hot keys are spread over several tasks, whichever side they are hot on.

    The rows of a key form a matrix of ceil(n / block) left by ceil(m / block)
    right blocks, and every field of it is a join key of its own: no task meets
    more than about block x block pairs of one key.  Left rows are copied once
    per right block and the other way round; keys below the block size on both
    sides are joined as usual.  ``right_id`` deals the right rows out (all columns
    unless given).  ``shuffled`` spreads both sides over all partitions and never
    broadcasts one, whatever the sizes of their files.
    """
    keys = list(keys)

    def joined_on(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        return spread(a, on).join(spread(b, on), on, "inner") if shuffled else a.join(b, on, "inner")

    hot = hot_counts(left, keys, block).withColumnRenamed("__blocks", "__p_blocks").join(
        hot_counts(right, keys, block).withColumnRenamed("__blocks", "__q_blocks"), keys, "full_outer"
    )
    hot = checkpoint(hot)
    if hot.isEmpty():
        joined = joined_on(left, right, keys)
        return joined if condition is None else joined.filter(condition)
    one = F.lit(1)
    p_blocks, q_blocks = F.coalesce("__p_blocks", one), F.coalesce("__q_blocks", one)

    def placed(df: DataFrame, own: str, own_blocks: Column, dealt: Sequence[str], other: str, blocks: Column) -> DataFrame:
        mine = F.pmod(F.xxhash64(*dealt), own_blocks).cast("int")
        return (
            df.join(hot, keys, "left")
            .withColumn(own, mine)
            .withColumn(other, F.explode(F.sequence(F.lit(0), blocks - 1)))
            .drop("__p_blocks", "__q_blocks")
        )

    joined = joined_on(
        placed(left, "__p", p_blocks, row_id, "__q", q_blocks),
        placed(right, "__q", q_blocks, right_id or right.columns, "__p", p_blocks),
        [*keys, "__p", "__q"],
    )
    if condition is not None:
        joined = joined.filter(condition)
    return joined.drop("__p", "__q")


def pairs_within(
    df: DataFrame, keys: Sequence[str], row_id: str, block: int = PAIR_BLOCK
) -> DataFrame:
    """Unordered pairs of rows that share a key, as structs ``a`` and ``b``.

    ``a`` is the row with the smaller ``row_id``.  A key with n rows is split
    into ceil(n / block) blocks and every pair of blocks is a join key of its
    own, so no task meets more than block x block candidates of one key.
    """
    keys = list(keys)
    columns = df.columns
    hot = hot_counts(df, keys, block)
    placed = with_blocks(df, keys, hot).withColumn(
        "__block", F.pmod(F.xxhash64(row_id), F.col("__blocks")).cast("int")
    )
    packed = placed.select(
        *keys, "__block", "__blocks", F.struct(*columns).alias("row")
    )
    left = packed.select(
        *keys,
        F.col("__block").alias("__p"),
        F.explode(F.sequence("__block", F.col("__blocks") - 1)).alias("__q"),
        F.col("row").alias("a"),
    )
    right = packed.select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.col("__block"))).alias("__p"),
        F.col("__block").alias("__q"),
        F.col("row").alias("b"),
    )
    different = F.col(f"a.{row_id}") != F.col(f"b.{row_id}")
    once = (F.col("__p") != F.col("__q")) | (F.col(f"a.{row_id}") < F.col(f"b.{row_id}"))
    joined = left.join(right, [*keys, "__p", "__q"], "inner").filter(different & once)
    in_order = F.col(f"a.{row_id}") < F.col(f"b.{row_id}")
    return joined.select(
        *keys,
        F.when(in_order, F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(in_order, F.col("b")).otherwise(F.col("a")).alias("b"),
    )


def require_none(df: DataFrame, message: str) -> None:
    """Raise with a few examples when ``df`` has rows."""
    examples = df.limit(5).collect()
    if examples:
        raise ValueError(f"{message}: {[row.asDict() for row in examples]}")


def require_unique(df: DataFrame, keys: Sequence[str], message: str) -> None:
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    require_none(repeated, message)
