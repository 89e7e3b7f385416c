"""Ordered work inside groups whose size has no bound.

A window over a hot key would put all its rows into one task. Every operator here works on (key, block) pairs
instead: a block is a run of the order column, blocks are summed up on their own, and only one small row per
block goes through the window that spans the whole key. A block should hold some ten thousand to some hundred thousand
rows of the hottest key: fewer make the outer window long, more make one task slow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorebase.session import persist_table

ROWS_PER_BLOCK = 1 << 18
TEXTS_PER_BLOCK = 1 << 16


def _edge_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    picked = df.groupBy(*keys).agg(pick(row, F.struct(*[F.col(c) for c in order])).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. An aggregate, so each map task sends one row per key."""
    return _edge_row(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key (later ones overwrite)."""
    return _edge_row(df, keys, order, F.max_by)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank.

    Spark turns ``row_number() <= k`` into a limit per key ahead of the shuffle, so a hot key ships at most ``k``
    rows per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def with_prefix(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column, name: str, below: int | None = None
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all earlier rows of the key.

    ``block`` must not decrease along ``order`` (a coarser cut of the first order column). With ``below`` rows whose sum
    reaches it are left out, and whole blocks of them before their rows are looked at.
    """
    keyed = df.withColumn("_block", block).withColumn("_value", value)
    per_block = keyed.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    if below is not None:
        offsets = offsets.filter(F.col("_offset") < below)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("_value").over(inner), F.lit(0))
    summed = keyed.join(offsets, [*keys, "_block"]).withColumn(name, F.col("_offset") + local)
    if below is not None:
        summed = summed.filter(F.col(name) < below)
    return summed.drop("_block", "_value", "_offset")


def numbered_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, 3 ... within the key along ``order``, for order columns that can't be cut into blocks by a formula.

    Rows are range-partitioned by key and order, with borders from a sample, so a key of any size is spread over tasks;
    each range numbers its rows by itself, and one row per key and range carries how many came before.
    """
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ordered = persist_table(ordered.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_range", F.shiftright("_at", 33))
    ranges = ordered.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_range").alias("_of"),
                           (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0)) - 1).alias("_shift"))
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return ordered.join(ranges, same).select(*df.columns, (F.col("_at") - F.col("_shift")).alias(name))


def numbered_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str) -> DataFrame:
    """Adds ``name``: 1, 2, 3 ... within the key along ``order``."""
    return with_prefix(df, keys, order, block, F.lit(1), name).withColumn(name, F.col(name) + 1)


def with_last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column, name: str
) -> DataFrame:
    """Adds ``name``: the latest non-null ``value`` up to and including the row, else null."""
    keyed = df.withColumn("_block", block).withColumn("_value", value)
    at = F.struct(*[F.col(c) for c in order])
    per_block = keyed.groupBy(*keys, "_block").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), at)).alias("_last")
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(*keys, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inner = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.withColumn("_local", F.last("_value", ignorenulls=True).over(inner))
    return (
        local.join(carried, [*keys, "_block"])
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop("_block", "_value", "_local", "_carried")
    )
