"""Quotation linking: conversations rebuilt from what messages quote.

A line's quote level is the number of ``>`` before it; neighbouring lines of one level are a passage. What a message says
itself is its lines without a level. Passages and own texts are normalised (case, white space) and hashed; a quoted passage
links to the first message of its thread that says it, as a whole or as one line of some length. A message replies to the
latest message that it quotes at the lowest level that links. Following replies, by pointer doubling, gives each message
its root and depth, and a conversation is the messages of one root in reply order, without their quotes.

All on Spark's functions. Originals are reduced to one row per thread and hash before the join, and orders within a
conversation are counted in blocks, so that neither a common line nor a long thread meets in one task.

Defined results: a null text is empty; equal rows (thread, turn, role, text) are one message that counts its copies; a
message without thread or turn is a conversation of its own; an empty table gives no rows. Only the named columns are read,
so further columns can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import summed_rank
from lorebase.session import persist_table

LINE_WORDS = 5
ORDER_BLOCK = 4096
_PREFIX = r"^((?:>[ ]?)+)"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def parse(messages: DataFrame, thread: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``thread, turn, role, m, copies, own, quotes``: quotes are ``level, passage`` in the order of the text; ``m`` names the message."""
    df = messages.select(F.col(thread).alias("thread"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = df.groupBy("thread", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("m", F.xxhash64("thread", "turn", "role", "text"))
    df = df.withColumn("lines", F.transform(F.split("text", "\n"), lambda x: F.struct(F.regexp_extract(x, _PREFIX, 1).alias("prefix"), x.alias("line"))))
    df = df.withColumn("lines", F.transform("lines", lambda x: F.struct(
        F.char_length(F.translate(x["prefix"], " ", "")).alias("level"), F.substr(x["line"], F.char_length(x["prefix"]) + 1).alias("body"))))
    df = df.withColumn("level", F.col("lines.level")).withColumn("body", F.col("lines.body"))
    df = df.withColumn("opens", F.filter(F.sequence(F.lit(0), F.size("level") - 1), lambda i: (i == 0) | (F.get("level", i) != F.get("level", i - 1))))
    df = df.withColumn("ends", F.concat(F.expr("slice(opens, 2, size(opens))"), F.array(F.size("level"))))
    passages = F.zip_with("opens", "ends", lambda a, b: F.struct(F.get("level", a).alias("level"), F.array_join(F.slice("body", a + 1, b - a), "\n").alias("passage")))
    df = df.withColumn("passages", passages)
    own = F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["passage"]), "\n")
    return df.select("thread", "turn", "role", "m", "copies", F.trim(own, F.lit(" \n\t")).alias("own"),
                     F.filter("passages", lambda p: (p["level"] > 0) & (normalised(p["passage"]) != "")).alias("quotes"))


def _lines(text: Column) -> Column:
    """The lines that are long enough to tell a message by."""
    return F.filter(F.split(text, "\n"), lambda x: F.size(F.split(normalised(x), " ")) >= LINE_WORDS)


def link(parsed: DataFrame) -> DataFrame:
    """``thread, m, level, turn, original``: quoted passages and the earlier message each comes from."""
    named = parsed.where("thread is not null and turn is not null")
    says = named.where("own <> ''").select("thread", "turn", "m", F.explode(F.concat(F.array(F.col("own")), _lines(F.col("own")))).alias("said"))
    first = says.groupBy("thread", _hash(F.col("said")).alias("h")).agg(F.min(F.struct("turn", "m")).alias("o"))
    quoted = named.select("thread", "m", F.col("turn").alias("at"), F.posexplode("quotes").alias("n", "q"))
    whole = F.struct(F.lit(True).alias("whole"), F.col("q.passage").alias("part"))
    parts = F.concat(F.array(whole), F.transform(_lines(F.col("q.passage")), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("part"))))
    quoted = quoted.select("thread", "m", "at", "n", F.col("q.level").alias("level"), F.explode(parts).alias("p"))
    quoted = quoted.select("thread", "m", "at", "n", "level", F.col("p.whole").alias("whole"), _hash(F.col("p.part")).alias("h"))
    found = quoted.join(first, ["thread", "h"]).where((F.col("o.turn") < F.col("at")) & (F.col("o.m") != F.col("m")))
    best = found.groupBy("thread", "m", "n", "level").agg(F.max(F.struct("whole", "o")).alias("b"))  # a whole passage counts before its lines
    return best.select("thread", "m", "level", F.col("b.o.turn").alias("turn"), F.col("b.o.m").alias("original"))


def _to_roots(step: DataFrame) -> DataFrame:
    """Pointer doubling over ``thread, m, up, up_turn, depth``: ``up`` becomes the root, ``depth`` the way to it.

    Only messages that are not there yet take part in a round, so short threads leave a long one's rounds.
    """
    done, active = [step.where("depth = 0")], step.where("depth > 0")
    while True:
        above = reduce(DataFrame.unionByName, [active, *done[1:]]).select("thread", F.col("m").alias("up"), F.col("up").alias("next"), F.col("up_turn").alias("next_turn"), F.col("depth").alias("more"))
        fresh = persist_table(active.join(above, ["thread", "up"], "left").select(
            "thread", "m", F.coalesce("next", "up").alias("up"), F.coalesce("next_turn", "up_turn").alias("up_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "replies")
        done.append(fresh.where("not moved").drop("moved"))
        active = fresh.where("moved").drop("moved")
        if not active.limit(1).count():
            return reduce(DataFrame.unionByName, done)


def conversations(messages: DataFrame, thread: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``thread, turn, role, copies, own, n_quotes, n_linked, reply_to, root, depth, place`` of every message.

    ``reply_to`` and ``root`` are turns; ``place`` counts the messages of one root in reply order from 0.
    """
    parsed = persist_table(parse(messages, thread, turn, role, text), "messages")
    links = persist_table(link(parsed), "quotes")
    parents = links.groupBy("thread", "m").agg(F.count(F.lit(1)).alias("n_linked"), F.min(F.struct("level", (-F.col("turn")).alias("back"), F.col("original"))).alias("p"))
    nodes = parsed.select("thread", "turn", "role", "m", "copies", "own", F.size("quotes").alias("n_quotes"))
    nodes = nodes.join(parents, ["thread", "m"], "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0)).cast("int"))
    step = nodes.select("thread", "m", F.coalesce("p.original", "m").alias("up"), F.coalesce(-F.col("p.back"), "turn").alias("up_turn"), F.col("p").isNotNull().cast("int").alias("depth"))
    step = _to_roots(persist_table(step, "replies"))
    placed = nodes.join(step, ["thread", "m"], "left")
    placed = placed.select("thread", "turn", "role", "copies", "own", "n_quotes", "n_linked", (-F.col("p.back")).alias("reply_to"), F.coalesce("up_turn", "turn").alias("root"),
                           F.coalesce("up", "m").alias("root_m"), F.coalesce("depth", F.lit(0)).alias("depth"), "m")
    block = F.shiftleft(F.col("depth").cast("long"), 40) + F.coalesce(F.floor(F.col("turn") / ORDER_BLOCK), F.lit(0))
    ranked = summed_rank(placed.withColumn("_block", block), ["thread", "root_m"], "_block", [F.col("depth"), F.col("turn"), F.col("m")], "place")
    return ranked.select("thread", "turn", "role", "copies", "own", "n_quotes", "n_linked", "reply_to", "root", "depth", "place")


def as_reply_mails(turns: DataFrame, thread: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns as mails: each quotes the turn before it, and that one's own quote of the turn before at a second level."""
    base = turns.select(F.col(thread).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    before = base.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    quoted = lambda x, mark: F.concat(F.lit(mark), F.regexp_replace(x, "\n", "\n" + mark), F.lit("\n"))
    one = before.select("conv_id", (F.col("turn") + 1).alias("turn"), quoted(F.col("said"), "> ").alias("one"))
    two = before.select("conv_id", (F.col("turn") + 2).alias("turn"), quoted(F.col("said"), "> > ").alias("two"))
    mails = base.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    return mails.select("conv_id", "turn", "role", F.concat(F.coalesce("two", F.lit("")), F.coalesce("one", F.lit("")), "text").alias("text"))
