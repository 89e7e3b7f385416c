"""Message feeds as batch operators: duplicates, bootstrap and backfill, reordering, chat context, modes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from lorebase import rules
from lorebase.operators.grouping import first_per_key, top_per_key, with_last_known
from lorebase.session import persist_table

_NONE = np.iinfo(np.int64).min


def unseen(messages: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Messages whose id is new."""
    return messages.join(seen.select(key).distinct(), key, "left_anti")


def new_messages(messages: DataFrame, seen: DataFrame, key: str, order: Sequence[str], kind: str = "msg_type") -> DataFrame:
    """New, non-system messages, one row per id.

    Repeats are folded per task before anything is shuffled, and the anti join runs on the same partitioning.
    """
    return unseen(first_per_key(messages.filter(F.lower(F.col(kind)) != "system"), [key], order), seen, key)


def bootstrap_split(messages: DataFrame, bootstrapped_chats: DataFrame, seen: DataFrame, key: str, chat: str) -> DataFrame:
    """What a poll does with each message: ``backfill`` for chats met for the first time, ``live`` for new messages
    of known chats, ``seen`` for the rest."""
    known = bootstrapped_chats.select(chat).distinct().withColumn("_known", F.lit(True))
    already = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    routed = messages.join(known, chat, "left").join(already, key, "left")
    action = F.when(F.col("_seen"), "seen").when(F.col("_known").isNull(), "backfill").otherwise("live")
    return routed.withColumn("action", action).drop("_known", "_seen")


def known_chats(visible: DataFrame, configured: DataFrame) -> DataFrame:
    """``chat_id, chat_type``: the chats a service lists, and configured ones that it does not, as groups; blank ids are left out."""
    more = configured.select(F.col("chat_id").cast("string").alias("chat_id")).where("chat_id <> ''").distinct()
    listed = visible.select("chat_id", "chat_type")
    return listed.unionByName(more.join(listed.select("chat_id"), "chat_id", "left_anti").select("chat_id", F.lit("group").alias("chat_type")))


def retained_ids(ids: DataFrame, key: str, limit: int) -> DataFrame:
    """The ids a mail state of bounded length keeps: the last ``limit`` in string order, so older ids may come back as new.
    Use a watermark on the stream (``live_messages``) where that matters."""
    return ids.select(F.col(key).cast("string").alias(key)).distinct().orderBy(F.desc(key)).limit(limit)


def numeric_first(value: Column) -> Column:
    """Sort key that puts numbers in numeric order ahead of other text."""
    digits = value.rlike(r"^\d+$")
    return F.struct(
        F.when(digits, 0).otherwise(1).alias("group"), F.when(digits, value.cast("decimal(38,0)")).alias("number"),
        F.when(~digits, value).alias("text"),
    )


def recent_turns(turns: DataFrame, chat: str, order: str, age: Column | None = None,
                 max_turns: int = rules.CONTEXT_TURNS, max_age: int = rules.CONTEXT_AGE_SECONDS) -> DataFrame:
    """The last ``max_turns`` turns of each chat, then those young enough; older ones do not move up."""
    last = top_per_key(turns, [chat], [F.desc(order)], max(1, min(max_turns, rules.CONTEXT_KEPT)), "turns_back")
    return last if age is None else last.filter(F.coalesce(age, F.lit(0)) <= max(60, max_age))


def modes(messages: DataFrame, chat: str, order: Sequence[str], block: Column, command: Column) -> DataFrame:
    """The mode each message is handled in (ask unless a record_on is open), its own command included."""
    switch = F.when(command == "record_on", "record").when(command == "record_off", "ask")
    with_mode = with_last_known(messages, [chat], order, block, switch, "mode")
    return with_mode.withColumn("mode", F.coalesce("mode", F.lit("ask")))


def _running_max(event_time: str, names: Sequence[str]):
    """Adds the number of the range and the latest event time among the range's rows before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, top = TaskContext.get().partitionId(), None
        for batch in batches:
            times = pc.fill_null(batch.column(event_time), _NONE).to_numpy()
            seen = np.maximum.accumulate(np.concatenate([[_NONE if top is None else top], times]))
            top = seen[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(times), number, np.int32)), pa.array(seen[:-1], mask=seen[:-1] == _NONE)], names=[*names, "_range", "_local"])

    return run


def late_rows(messages: DataFrame, arrival: str, event_time: str) -> DataFrame:
    """Rows that arrive after a row with a later event time (a whole number); ``latest_before`` is that latest event time.

    Rows are range-partitioned by arrival. Each range keeps its running maximum; the tops of the ranges, one number per
    range, are run through on the driver and added back. Rows of one arrival are in no order and end up in one range.
    """
    ordered = messages.withColumn(event_time, F.col(event_time).cast("long")).repartitionByRange(arrival).sortWithinPartitions(arrival)
    schema = StructType([*ordered.schema.fields, StructField("_range", IntegerType()), StructField("_local", LongType())])
    kept = persist_table(ordered.mapInArrow(_running_max(event_time, messages.columns), schema), "arrivals")
    tops, carried, top = kept.groupBy("_range").agg(F.max(event_time).alias("top")).collect(), [], None
    for row in sorted(tops, key=lambda r: r["_range"]):
        carried.append((row["_range"], top))
        top = max((t for t in (top, row["top"]) if t is not None), default=None)
    before = F.broadcast(messages.sparkSession.createDataFrame(carried, "_range INT, _carried LONG"))  # one row per range
    return kept.join(before, "_range").withColumn("latest_before", F.greatest("_local", "_carried")).filter(
        F.col(event_time) < F.col("latest_before")).drop("_range", "_local", "_carried")


def sessions(messages: DataFrame, chat: str, micros: Column, gap_minutes: int = 30) -> DataFrame:
    """Activity sessions per chat: a message opens one when the last message is ``gap_minutes`` or more ago.

    Messages of one gap-long slot always share a session, so they are first summed up per slot. What goes through the
    window per chat is one row per busy slot, however many messages a chat has. Times are microseconds.
    """
    gap = gap_minutes * 60 * 1_000_000
    slots = messages.select(chat, micros.alias("at")).groupBy(chat, F.floor(F.col("at") / gap).alias("slot")).agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("messages")
    )
    along = Window.partitionBy(chat).orderBy("slot")
    opens = F.coalesce(F.col("first") >= F.lag("last").over(along) + gap, F.lit(True))
    numbered = slots.withColumn("opens", opens.cast("int")).withColumn("session", F.sum("opens").over(along))
    return numbered.groupBy(chat, "session").agg(
        F.min("first").alias("started"), (F.max("last") + gap).alias("ended"), F.sum("messages").alias("messages")
    ).drop("session")
