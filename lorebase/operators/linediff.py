"""Line diffs of changed pages as joins over hashed, numbered lines.

Lines that are unique on both sides of a page are its candidates for anchors; the longest run of them that rises on both
sides are the anchors. Only what lies between two anchors is compared further, on hashes: equal ends are trimmed, lines unique
within the gap anchor it again, and a small rest is matched exactly. A large rest without any unique line counts as
replaced, so the work per page stays about linear. Unique lines that are on both sides but out of order are moves.

A page is the unit of every window and group here, so what a task holds is bounded by one page's line hashes. Text is
fetched at the end, for the lines shown.
"""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from lorebase import rules
from lorebase.session import persist_table

LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: a gap with more pairs of lines than this and without a unique line counts as replaced
EXACT_PAIRS = 250_000


def split_lines(text: Column) -> Column:
    """Lines without their ends; a text that ends in a line end has no empty line after it."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first number, whose second numbers rise as well."""
    tops: list[int] = []
    ends: list[int] = []
    before = []
    for at, (_, j) in enumerate(pairs):
        spot = bisect_left(tops, j)
        before.append(ends[spot - 1] if spot else -1)
        if spot == len(tops):
            tops.append(j)
            ends.append(at)
        else:
            tops[spot], ends[spot] = j, at
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def match_gap(old: list[int], new: list[int]) -> list[tuple[int, int]]:
    """Places of equal lines that stay, in order, within a gap between two anchors."""
    out, todo = [], [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and old[a] == new[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        sides = []
        for lines, low, high in ((old, a, b), (new, c, d)):
            places: dict[int, int] = {}
            for n in range(low, high):
                places[lines[n]] = -1 if lines[n] in places else n
            sides.append(places)
        chain = rising([(i, sides[1][h]) for h, i in sides[0].items() if i >= 0 and sides[1].get(h, -1) >= 0])
        if chain:
            out += chain
            edges = [(a - 1, c - 1), *chain, (b, d)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
        elif (b - a) * (d - c) <= EXACT_PAIRS:
            for block in SequenceMatcher(None, old[a:b], new[c:d], autojunk=False).get_matching_blocks():
                out += [(a + block.a + n, c + block.b + n) for n in range(block.size)]
    return sorted(out)


_PAIRS = ArrayType(StructType([StructField("i", IntegerType()), StructField("j", IntegerType())]))


@F.arrow_udf(_PAIRS)
def _gap_pairs(old: pa.Array, new: pa.Array) -> pa.Array:
    found = [match_gap(a or [], b or []) for a, b in zip(old.to_pylist(), new.to_pylist(), strict=True)]
    return pa.array([[{"i": i, "j": j} for i, j in pairs] for pairs in found], pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])))


def _chains(page: pa.Table) -> pa.Table:
    pairs = sorted(zip(page.column("i").to_pylist(), page.column("j").to_pylist(), strict=True))
    chain = rising(pairs)
    return pa.table({"key": pa.array([page.column("key")[0].as_py()] * len(chain), page.schema.field("key").type),
                     "i": pa.array([i for i, _ in chain], pa.int32()), "j": pa.array([j for _, j in chain], pa.int32())})


def _sides(pairs: DataFrame) -> DataFrame:
    """Pairs as one row per side."""
    return pairs.select("key", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("n")), F.struct(F.lit(1).alias("side"), F.col("j").alias("n")))).alias("x")).select("key", "x.*")


def line_hunks(pages: DataFrame, context: int = rules.DIFF_CONTEXT, key: str = "key", old: str = "old_text", new: str = "text") -> DataFrame:
    """The hunks of each page whose lines differ: ``key, hunk, old_start, old_lines, new_start, new_lines, lines``.

    ``lines`` are (sign, text, moved) in diff order: ``-`` and ``+`` with up to ``context`` kept lines around. ``moved`` is the
    line number on the other side of a line that only changed its place. Starts count from 1, and from 0 for an empty side.
    ``pages``: a unique key and both texts; null texts are empty.
    """
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(old).alias("text")), F.struct(F.lit(1).alias("side"), F.col(new).alias("text"))))
    texts = pages.select(F.col(key).alias("key"), sides.alias("x")).select("key", "x.side", split_lines(F.col("x.text")).alias("all"))
    lines = persist_table(texts.select("key", "side", F.posexplode("all").alias("n", "line")).withColumn("h", F.xxhash64("line")), "lines")
    of = lambda side: F.col("side") == side
    both = lines.groupBy("key", "h").agg(F.count_if(of(0)).alias("o"), F.count_if(of(1)).alias("c"), F.min(F.when(of(0), F.col("n"))).alias("i"), F.min(F.when(of(1), F.col("n"))).alias("j"))
    unique = persist_table(both.where("o = 1 AND c = 1").select("key", "i", "j"), "anchors")
    key_type = pages.schema[key].dataType.simpleString()
    chain = persist_table(unique.groupBy("key").applyInArrow(_chains, f"key {key_type}, i int, j int"), "chains")
    along = Window.partitionBy("key", "side").orderBy("n")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    bare = lines.select("key", "side", "n", "h").join(_sides(chain).withColumn("anchor", F.lit(1)), ["key", "side", "n"], "left")
    gaps = bare.withColumn("gap", F.coalesce(F.sum("anchor").over(earlier), F.lit(0))).where("anchor IS NULL")
    inside = gaps.groupBy("key", "gap").agg(*[F.sort_array(F.collect_list(F.when(of(s), F.struct("n", "h")))).alias(f"s{s}") for s in (0, 1)]).where("size(s0) > 0 AND size(s1) > 0")
    hashes = [F.transform(f"s{s}", lambda x: x["h"]) for s in (0, 1)]
    pairs = inside.select("key", F.col("s0")[0]["n"].alias("a"), F.col("s1")[0]["n"].alias("b"), _gap_pairs(*hashes).alias("pairs"))
    pairs = pairs.select("key", "a", "b", F.explode("pairs").alias("p")).select("key", (F.col("a") + F.col("p.i")).alias("i"), (F.col("b") + F.col("p.j")).alias("j"))
    kept = _sides(chain.unionByName(pairs)).withColumn("kept", F.lit(1))
    # a changed line's place is the number of kept lines before it; the kept line of that number follows it
    placed = lines.select("key", "side", "n").join(kept, ["key", "side", "n"], "left").withColumn("place", F.coalesce(F.sum("kept").over(earlier), F.lit(0)))
    kind = F.when(F.col("kept").isNotNull(), 2).otherwise(F.col("side"))
    merged = placed.where("kept IS NULL OR side = 0").withColumn("kind", kind)
    order = Window.partitionBy("key").orderBy("place", "kind", "n")
    up, down, past = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("kind") < 2, F.col("place"))
    near = (F.col("kind") < 2) | (F.col("place") - F.col("_last") < context) | (F.col("_next") - F.col("place") <= context)
    shown = merged.withColumns({"_last": F.max(change).over(up), "_next": F.min(change).over(down)}).withColumn("_near", F.coalesce(near, F.lit(False)))
    count = lambda condition: F.coalesce(F.sum(condition.cast("int")).over(past), F.lit(0))
    shown = shown.withColumns({"hunk": count(~F.col("_near")), "old_at": count(F.col("kind") != 1), "new_at": count(F.col("kind") != 0)}).where("_near")
    there = unique.select("key", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("n"), F.col("j").alias("to")), F.struct(F.lit(1).alias("side"), F.col("j").alias("n"), F.col("i").alias("to")))).alias("x")).select("key", "x.*")
    told = shown.join(lines.select("key", "side", "n", "line"), ["key", "side", "n"]).join(there, ["key", "side", "n"], "left")
    row = F.struct("place", "kind", "n", F.element_at(F.array(F.lit("-"), F.lit("+"), F.lit(" ")), F.col("kind") + 1).alias("sign"), F.col("line").alias("text"),
                   F.when(F.col("kind") < 2, F.col("to") + 1).alias("moved"))
    hunks = told.groupBy("key", "hunk").agg(F.min("old_at").alias("_old"), F.count_if(F.col("kind") != 1).alias("old_lines"), F.min("new_at").alias("_new"),
                                            F.count_if(F.col("kind") != 0).alias("new_lines"), F.sort_array(F.collect_list(row)).alias("_rows"))
    start = lambda at, size: (F.col(at) + (F.col(size) > 0).cast("int")).cast("long")
    return hunks.select("key", F.row_number().over(Window.partitionBy("key").orderBy("hunk")).alias("hunk"), start("_old", "old_lines").alias("old_start"), "old_lines",
                        start("_new", "new_lines").alias("new_start"), "new_lines", F.transform("_rows", lambda r: F.struct(r["sign"], r["text"], r["moved"])).alias("lines"))


def _range(start: str, size: str) -> Column:
    return F.when(F.col(size) == 1, F.col(start).cast("string")).otherwise(F.concat_ws(",", start, size))


def hunk_head() -> Column:
    return F.concat(F.lit("@@ -"), _range("old_start", "old_lines"), F.lit(" +"), _range("new_start", "new_lines"), F.lit(" @@"))


def unified(hunks: DataFrame, max_lines: int = rules.MAX_DIFF_LINES) -> DataFrame:
    """``key, diff``: the hunks of a page as one unified diff of at most ``max_lines`` lines and a note of how many were left out."""
    body = F.concat(F.array(hunk_head()), F.transform("lines", lambda x: F.concat(x["sign"], x["text"])))
    pages = hunks.select("key", F.struct("hunk", body.alias("body")).alias("_h")).groupBy("key").agg(F.sort_array(F.collect_list("_h")).alias("_hunks"))
    whole = F.concat(F.array(F.lit("--- previous"), F.lit("+++ current")), F.flatten(F.transform("_hunks", lambda h: h["body"])))
    more = F.size("_diff") - max_lines
    note = F.array(F.concat(F.lit("... diff truncated, "), more.cast("string"), F.lit(" lines omitted ...")))
    return pages.withColumn("_diff", whole).select("key", F.when(more > 0, F.concat(F.slice("_diff", 1, max_lines), note)).otherwise(F.col("_diff")).alias("diff"))
