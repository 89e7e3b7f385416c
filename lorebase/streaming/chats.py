"""Chat modes and chat memory as keyed state with event-time timers.

Messages of a chat may arrive out of order. They wait in the state until the watermark has passed them and are then
handled in event order, so a stream gives what the batch operator gives over the same messages. Messages older than the
watermark when they arrive never reach the state (``delivery.deliver`` keeps them in a table of their own), so a late
old command can't override a newer one.

State: the messages of the last ``delay`` that still wait, and a mode or ten turn times per chat. Every call into the state
store costs about as much as a hundred messages, so chats share ``slots`` keys by their hash, and the state of a slot is packed
arrays that numpy handles as a whole. The store writes the slots a batch changes. Spark hands rows to a stateful processor one by
one in Python, so messages come packed as well, some hundred of a slot in a row; of a pack that is late in part the processor
leaves out what the watermark has passed. Times are microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lorebase import rules

SLOTS = 1024
PACK_ROWS = 1 << 18
#: ``known`` is 0 for messages without a chat; commands are numbers: 1 record_on, 2 record_off, 0 none of them
_MESSAGE = np.dtype([("known", "i1"), ("chat_id", "<i8"), ("at", "<i8"), ("event_id", "<i8"), ("command", "i1")])
_TIME = np.dtype([("known", "i1"), ("chat_id", "<i8"), ("at", "<i8")])
_PACKED = "packed BINARY"
_NO_TIME = np.iinfo(np.int64).min
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession, partitions: int | None = None):
    """A stream started inside keeps its state in RocksDB, in ``partitions`` parts that stay for its life."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _chat_ids(rows: np.ndarray) -> pd.Series:
    return pd.Series(pd.arrays.IntegerArray(rows["chat_id"].astype(np.int64), rows["known"] == 0))


def _starts(rows: np.ndarray) -> np.ndarray:
    """For each row of a table in order of its chats, where its chat begins."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows["chat_id"][1:] != rows["chat_id"][:-1]) | (rows["known"][1:] != rows["known"][:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))


class InEventOrder(StatefulProcessor):
    """Hands the messages of a slot to ``step`` by chat and in event order, once the watermark has passed them.

    A message without an id is a heartbeat: it moves the watermark and leaves no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _PACKED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            if "packed" in frame:
                fresh = np.frombuffer(b"".join(bytes(p) for p in frame["packed"]), _MESSAGE)
                fresh = fresh[(fresh["at"] > passed) | (fresh["at"] == _NO_TIME)]
            else:  # a message a row, of which Spark has dropped the late ones
                frame = frame[frame["beat"] == 0]
                fresh = np.empty(len(frame), _MESSAGE)
                for name in _MESSAGE.names:
                    fresh[name] = frame[name].to_numpy()
            if len(fresh):
                self.waiting.appendValue((fresh.tobytes(),))
                self.handle.registerTimer(-(-int(fresh["at"].min()) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        held = np.frombuffer(b"".join(bytes(r[0]) for r in self.waiting.get()), _MESSAGE)
        ready, rest = held[held["at"] <= passed], held[held["at"] > passed]
        if len(ready):
            if len(rest):
                self.waiting.put([(rest.tobytes(),)])
                self.handle.registerTimer(-(-int(rest["at"].min()) // 1000))
            else:
                self.waiting.clear()
        ready = ready[np.lexsort((ready["event_id"], ready["at"], ready["chat_id"], ready["known"]))]
        yield from self.step(ready, passed)

    def step(self, messages: np.ndarray, passed: int) -> Iterator[pd.DataFrame]:
        """``messages``: those that are due, maybe none. All up to ``passed`` are handled with them, so what no later one can
        need is dropped."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class ModeMachine(InEventOrder):
    """ask until a record_on, record until a record_off; a command's own message is handled in its new mode."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.mode = handle.getValueState("mode", _PACKED)

    def step(self, messages, passed):
        if not len(messages):
            return
        packed = self.mode.get()
        last = np.frombuffer(bytes(packed[0]) if packed else b"", _MESSAGE)
        rows = np.concatenate([last, messages])
        fresh = np.arange(len(rows)) >= len(last)
        order = np.lexsort((fresh, rows["chat_id"], rows["known"]))  # stable: messages stay in event order
        rows, fresh = rows[order], fresh[order]
        start = _starts(rows)
        command = np.maximum.accumulate(np.where(rows["command"] > 0, np.arange(len(rows)), -1))
        recording = (command >= start) & (rows["command"][command] == 1)
        mode = np.where(recording, "record", "ask").astype(object)
        out = rows[fresh]
        yield pd.DataFrame({"chat_id": _chat_ids(out), "event_id": out["event_id"].astype(np.int64), "mode": mode[fresh]})
        if (out["command"] > 0).any():
            end = np.append(start[1:] != start[:-1], True)
            self.mode.update((rows[command[end & (command >= start)]].tobytes(),))


class TurnMemory(InEventOrder):
    """How many of the last turns a turn may refer to; the memory of a chat is gone when they are all too old."""

    def __init__(self, turns: int, kept: int, age: int):
        self.turns, self.kept, self.age = turns, kept, age

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.times = handle.getValueState("times", _PACKED)

    def step(self, messages, passed):
        packed = self.times.get()
        times = np.frombuffer(bytes(packed[0]) if packed else b"", _TIME)
        rows = np.concatenate([times, messages[list(_TIME.names)].astype(_TIME)])
        fresh = np.arange(len(rows)) >= len(times)
        order = np.lexsort((fresh, rows["chat_id"], rows["known"]))  # stable: turns stay in event order
        rows, fresh = rows[order], fresh[order]
        if not len(rows):
            return
        place = np.arange(len(rows))
        start, second = _starts(rows), rows["at"] // 1_000_000
        if len(messages):
            young = np.zeros(len(rows), np.int32)
            for back in range(1, min(self.turns, self.kept) + 1):
                before = place - back
                young += (before >= start) & (second - second[np.maximum(before, 0)] <= self.age)
            event = np.concatenate([np.zeros(len(times), np.int64), messages["event_id"]])[order]
            yield pd.DataFrame({"chat_id": _chat_ids(rows[fresh]), "event_id": event[fresh], "context_turns": young[fresh]})
        last = np.append(np.flatnonzero(start[1:] != start[:-1]), len(rows) - 1)
        last = last[np.searchsorted(last, place)]
        end = (second[last] + self.age + 1) * 1_000_000  # from here on no turn can refer to one of the chat
        stay = (place > last - self.kept) & (end > passed)
        if stay.any():
            self.times.update((rows[stay].tobytes(),))
            self.handle.registerTimer(int(end[stay].min()) // 1000)
        else:
            self.times.clear()


def _pack(rows: pa.Table) -> pa.RecordBatch:
    """A row per slot: its messages without the heartbeats, and the last time of both. Messages without a time come apart."""
    field = {c: rows[c].to_numpy() for c in rows.column_names if c != "at"}
    at = rows["at"].fill_null(_NO_TIME).to_numpy()
    key = 2 * field["slot"].astype(np.int64) + (at == _NO_TIME)
    order = np.argsort(key, kind="stable")
    key, at, real = key[order], at[order], field["beat"][order] == 0
    messages = np.empty(len(at), _MESSAGE)
    messages["at"] = at
    for name in ("known", "chat_id", "event_id", "command"):
        messages[name] = field[name][order]
    opens = np.flatnonzero(np.diff(key, prepend=-1))
    sizes = np.add.reduceat(real.astype(np.int64), opens)
    edges = np.concatenate([[0], np.cumsum(sizes)]) * _MESSAGE.itemsize
    packed = pa.Array.from_buffers(pa.binary(), len(opens), [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(messages[real].tobytes())])
    last = np.maximum.reduceat(at, opens)
    return pa.RecordBatch.from_arrays([pa.array((key[opens] // 2).astype(np.int32)), pa.array(last, mask=last == _NO_TIME), packed], names=["slot", "last", "packed"])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK_ROWS:
            yield _pack(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _pack(pa.Table.from_batches(held))


def _messages(feed: DataFrame, time: str, delay: str, command: str | None, slots: int) -> DataFrame:
    number = F.when(F.col(command) == "record_on", 1).when(F.col(command) == "record_off", 2).otherwise(0) if command else F.lit(0)
    zero = F.lit(0).cast("long")
    rows = feed.select(
        F.pmod(F.xxhash64("chat_id"), F.lit(slots)).cast("int").alias("slot"), F.col("chat_id").isNotNull().cast("int").alias("known"),
        F.coalesce(F.col("chat_id"), zero).alias("chat_id"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.coalesce(F.col("event_id"), zero).alias("event_id"),
        number.alias("command"), F.col("event_id").isNull().cast("int").alias("beat"))
    packs = rows.mapInArrow(_packs, "slot INT, last LONG, packed BINARY")
    return packs.select("slot", F.timestamp_micros("last").alias("last"), "packed").withWatermark("last", delay)


def modes(feed: DataFrame, delay: str, time: str = "ts", command: str = "command", slots: int = SLOTS) -> DataFrame:
    """``chat_id, event_id, mode`` of every message that is at most ``delay`` late. ``feed``: chat_id, event_id, ts, command.

    ``slots`` stays for the life of a stream; a slot should hold some thousand chats at most.
    """
    return _messages(feed, time, delay, command, slots).groupBy("slot").transformWithStateInPandas(
        ModeMachine(), "chat_id LONG, event_id LONG, mode STRING", "append", "eventTime")


def contexts(feed: DataFrame, delay: str, time: str = "ts", turns: int = rules.CONTEXT_TURNS, kept: int = rules.CONTEXT_KEPT,
             age: int = rules.CONTEXT_AGE_SECONDS, slots: int = SLOTS) -> DataFrame:
    """``chat_id, event_id, context_turns``: how many of the last turns are young enough to be referred to."""
    return _messages(feed, time, delay, None, slots).groupBy("slot").transformWithStateInPandas(
        TurnMemory(turns, kept, age), "chat_id LONG, event_id LONG, context_turns INT", "append", "eventTime")
