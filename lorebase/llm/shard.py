"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; the rank over the size of the source, from a start that
is random for each source, is a place between 0 and 1. Sorting all rows by it interleaves the sources in proportion, so
cutting the sorted rows into equal runs gives shards that each hold every source's share to within one row of that source,
and row counts that differ by one at most.

Defined results: a null text counts as empty, a null source is a source of its own, a null id sorts first; repeated rows
each get a place (which of two equal rows gets which does not matter); an empty table gives no rows. Only the named
columns are read, so further columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import summed_rank, utf8_size

BLOCK_ROWS = 20_000


def _unit(digest: Column) -> Column:
    """The first 32 bits of a digest as a number from 0 to 1."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def interleave(docs: DataFrame, shards: int, seed: int = 0, key: str = "doc_id", source: str = "source", text: str = "text",
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, source, size, text_crc32, place, shard, slot``: every row once, slots from 0 without gaps in each shard."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), (utf8_size(F.col(text)) + 1).alias("size"),
                       F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    total = docs.count()
    blocks = 1 + total // block_rows
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumn("_mix", shuffled)
    rows = rows.withColumn("_block", F.floor(_unit(F.col("_mix")) * blocks))
    order = [F.col("_mix"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = summed_rank(rows, ["source"], "_block", order, "_rank")
    start = _unit(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit(""))).cast("binary")))
    ranked = ranked.withColumn("place", (F.col("_rank") + start) / F.col("_rank_total"))
    ranked = ranked.withColumn("_block", F.floor(F.col("place") * blocks))
    placed = summed_rank(ranked, [], "_block", [F.col("place"), F.col("source"), *order], "_position")
    shard = F.expr(f"_position * {shards} div _position_total")
    first = F.expr(f"((_position * {shards} div _position_total) * _position_total + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "place", shard.cast("int").alias("shard"),
                         (F.col("_position") - first).cast("long").alias("slot"))
