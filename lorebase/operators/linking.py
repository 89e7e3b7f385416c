"""Connected components as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.session import persist_table


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """``node, component`` (the smallest node that links reach) from links ``a, b``; both orders and repeats are allowed.

    Rounds of large-star and small-star: neighbours of a node move to its smallest neighbour until every node hangs on
    the smallest of its component. All rounds are joins and aggregates over written tables, so nothing gathers at the
    driver, and a lost executor costs one round at most.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = persist_table(ordered(edges), label)
    before, after = None, state(pairs)
    while after != before:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = star.groupBy("a").agg(F.min("b").alias("m"))
        moved = star.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        pairs = persist_table(ordered(moved), label)
        before, after = after, state(pairs)
    hubs = pairs.select(F.col("a").alias("node")).distinct()
    return pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(hubs.withColumn("component", F.col("node")))
