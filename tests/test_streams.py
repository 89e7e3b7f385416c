"""Chat state and delivery over landed files: late messages, expiry, failures between any two writes."""

import datetime as dt
from collections import Counter

import numpy as np
import pytest

from lorebase.streaming import chats, delivery, feeds

START = dt.datetime(2026, 1, 1)
SCHEMA = "chat_id LONG, event_id LONG, ts TIMESTAMP, command STRING"


def minute(n):
    return START + dt.timedelta(minutes=n)


def land(spark, folder, files, schema):
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, stream, base, delay):
    with chats.keyed_state(spark, 2):
        feeds.write_table(stream(feeds.file_feed(spark, f"{base}/in", "*.parquet", SCHEMA, 1), delay), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def test_modes_follow_event_time_over_files_and_restarts(spark, tmp_path):
    """A command arrives late but in time; another, older than the watermark, must not override a newer one."""
    base = str(tmp_path)
    land(spark, f"{base}/in", [[(1, 1, minute(0), None), (1, 3, minute(2), "record_off"), (2, 4, minute(2), "record_on")],
                               [(1, 2, minute(1), "record_on"), (2, 5, minute(30), None)]], SCHEMA)
    run(spark, chats.modes, base, "10 minutes")
    land(spark, f"{base}/in", [[(1, 6, minute(41), None), (1, 7, minute(1), "record_on")], [(-1, None, minute(90), None)]], SCHEMA)
    out = run(spark, chats.modes, base, "10 minutes").collect()
    assert {r["event_id"]: r["mode"] for r in out} == {1: "ask", 2: "record", 3: "ask", 4: "record", 5: "record", 6: "ask"} and len(out) == 6


def test_memory_is_gone_after_half_an_hour(spark, tmp_path):
    base = str(tmp_path)
    land(spark, f"{base}/in", [[(1, i, minute(i), None) for i in range(9)], [(2, 20, minute(20), None)], [(1, 30, minute(37), None)],
                               [(1, 31, minute(100), None)], [(-1, None, minute(300), None)]], SCHEMA)
    out = run(spark, chats.contexts, base, "1 minute").collect()
    assert {r["event_id"]: r["context_turns"] for r in out} == {**{i: min(i, 6) for i in range(9)}, 20: 0, 30: 2, 31: 0}
    state = spark.read.format("statestore").option("stateVarName", "times").option("flattenCollectionTypes", True).load(f"{base}/checkpoint")
    assert state.count() == 0  # chat 1 and 2 hold nothing any more


def test_messages_reach_python_in_packs(spark):
    """A slot's messages are one row, not one each; heartbeats only move the time; a pack that is late in part loses that part."""
    rows = [(i % 7 if i % 5 else None, i, minute(i % 50) if i % 11 else None, ("record_on", "record_off", None)[i % 3]) for i in range(3000)]
    beats = [(-1, None, minute(60), None)] * 4
    packs = chats._messages(spark.createDataFrame(rows + beats, SCHEMA).coalesce(1), "ts", "1 minute", "command", 3).toPandas()
    assert len(packs) <= 2 * 3 and packs["last"].max() == minute(60)
    held = np.concatenate([np.frombuffer(p, chats._MESSAGE) for p in packs["packed"]])
    told = {int(m["event_id"]): (int(m["chat_id"]) if m["known"] else None, int(m["command"])) for m in held}
    assert told == {e: (c, {"record_on": 1, "record_off": 2, None: 0}[k]) for c, e, _, k in rows} and len(held) == 3000

    kept = []

    class State:
        appendValue = staticmethod(lambda value: kept.append(value[0]))

    class Handle:
        getListState = getValueState = staticmethod(lambda name, schema: State)
        registerTimer = staticmethod(lambda at: None)

    class Timers:
        getCurrentWatermarkInMs = staticmethod(lambda: int(minute(20).replace(tzinfo=dt.timezone.utc).timestamp() * 1000))

    machine = chats.ModeMachine()
    machine.init(Handle)
    assert not list(machine.handleInputRows((0,), iter([packs]), Timers))
    stayed = {int(m["event_id"]) for m in np.frombuffer(b"".join(kept), chats._MESSAGE)}
    assert stayed == {e for _, e, at, _ in rows if at is None or at > minute(20)}


def messages(*rows):
    return [(chat, str(n), minute(at), f"m{n}") for chat, n, at in rows]


FILES = [
    messages(("a", 1, 0), ("a", 2, 1)),
    messages(("a", 2, 1), ("a", 3, 30), ("b", 52, 31), ("b", 53, 32)),
    messages(("a", 4, 40), ("a", 5, 5), ("b", 54, 41), ("a", 4, 40)),
    messages(("a", 6, 50), ("a", 3, 30), ("b", 55, 51), ("c", 90, 52)),
    messages(("a", 7, 60), ("b", 56, 61), ("c", 91, 62), ("a", 8, 2)),
    messages(("b", 57, 70), ("a", 8, 2)),
]
# b has history up to its second message in the feed: pages of two, two pages a batch
HISTORY = {"b": [(n, n - 30) for n in range(40, 53)], "c": []}
WANT = Counter({
    **{("seen", "a", str(n), "feed"): 1 for n in (1, 2)}, **{("live", "a", str(n), "feed"): 1 for n in (3, 4, 6, 7)}, **{("late", "a", str(n), "feed"): 1 for n in (5, 8)},
    **{("backfill", "b", str(n), "history"): 1 for n in range(40, 52)}, **{("backfill", "b", str(n), "feed"): 1 for n in (52, 53, 54, 55, 56)}, ("live", "b", "57", "feed"): 1,
    ("backfill", "c", "90", "feed"): 1, ("live", "c", "91", "feed"): 1,
})


def history(spark, calls, fail_at=None):
    def get(chats_open):
        calls.append(sorted((r["chat_id"], r["token"]) for r in chats_open.collect()))
        if fail_at is not None and len(calls) == fail_at:
            raise RuntimeError("killed")
        rows = []
        for chat, token in calls[-1]:
            known, at = sorted(HISTORY[chat], reverse=True), int(token or 0)
            token = str(at + 4) if at + 4 < len(known) else None
            rows += [(chat, str(n), minute(t), f"m{n}", token) for n, t in known[at:at + 4]] or [(chat, None, None, None, None)]
        return spark.createDataFrame(rows, delivery.HISTORY)
    return get


def outcome(spark, base):
    out = delivery.Delivered(spark, base)
    return Counter((o, r["chat_id"], r["message_id"], r["origin"]) for o in delivery.OUTCOMES for r in out.table(o).collect())


@pytest.mark.parametrize("fail_at", [None, 1, 3])
def test_delivery_resumes_without_loss_or_repeats(spark, tmp_path, fail_at):
    """The first chat is bootstrapped, b is let in with a long history, c with none; ``fail_at``: killed after live and late were written."""
    base, calls = str(tmp_path), []

    def go(feed_history):
        feed = feeds.file_feed(spark, f"{base}/in", "*.parquet", delivery.MESSAGE, 1)
        delivery.deliver(feed, f"{base}/out", feed_history, 600, bootstrap=True).awaitTermination()

    land(spark, f"{base}/in", FILES[:3], delivery.MESSAGE)
    if fail_at:
        with pytest.raises(Exception, match="killed"):
            land(spark, f"{base}/in", FILES[3:], delivery.MESSAGE)
            go(history(spark, calls, fail_at))
        halfway = outcome(spark, f"{base}/out")
        assert not halfway - WANT
    else:
        go(history(spark, calls))  # a run that ends between two files
        land(spark, f"{base}/in", FILES[3:], delivery.MESSAGE)
    go(history(spark, calls))
    assert outcome(spark, f"{base}/out") == WANT
    assert [c for c in calls if c][:2] == ([[("b", "")], [("b", "4")]] if fail_at != 1 else [[("b", "")], [("b", "")]])
    late = delivery.Delivered(spark, f"{base}/out").table("late").collect()
    assert all(r["ts"] < START + dt.timedelta(microseconds=r["watermark"] - int(START.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000) for r in late)


def test_history_of_a_paged_service(spark):
    chats_open = spark.createDataFrame([("b", ""), ("c", None)], "chat_id STRING, token STRING")
    rows = delivery.paged_history("polled_service:aged", 2)(chats_open).collect()
    assert Counter((r["chat_id"], r["message_id"], r["token"]) for r in rows) == Counter([("b", "9", "5"), ("b", "8", "5"), ("b", "7", "5"), ("b", "6", "5"), ("c", None, None)])
