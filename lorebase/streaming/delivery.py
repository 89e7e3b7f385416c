"""What becomes of each message of a feed: live, backfill or late; chats met for the first time; resuming after a failure.

Every micro-batch writes its rows under ``batch=n`` to one table per outcome, then the lines of the ledger that it changed,
and last a commit file with the batch's numbers. A batch that runs again overwrites its own rows and reads the ledger of the
batches before it only, so a run stopped at any point goes on without loss or repeats. Readers see committed batches only.

* ``live``: new messages of known chats. A message counts once, also when it comes again within ``delay``.
* ``late``: messages older than the watermark when they arrive (the latest time of all batches before, less ``delay``),
  with that watermark beside their own time. They are kept in full; nothing downstream that relies on event order sees them.
* ``backfill``: everything of a chat that is not in the ledger yet: its messages in the feed, and its history page by page, a
  bounded number of pages per batch. The ledger holds each chat's next page token, so the next batch, or the next run, goes
  on there. When the last page is in, the chat's further messages are live.
* ``seen``: with ``bootstrap``, the messages of the very first batch. Their chats count as known, and nothing is handed on.

A history is a function from rows ``(chat_id, token)`` to rows ``(chat_id, message_id, ts, payload, token)``: the messages of up
to ``pages`` pages of each chat, each with the token to go on with (null on all rows of a chat: that was the last page). A
chat without any message left gives one row with a null message_id.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorebase.sources.files import or_empty
from lorebase.sources.polled import named

MESSAGE = "chat_id STRING, message_id STRING, ts TIMESTAMP, payload STRING"
HISTORY = f"{MESSAGE}, token STRING"
LEDGER = "chat_id STRING, token STRING, status STRING, batch LONG"
COMMIT = "batch LONG, latest LONG, watermark LONG, live LONG, late LONG, backfill LONG, seen LONG"
OUTCOMES = ("live", "late", "backfill", "seen")


def paged_history(fetch: str, pages: int = 20) -> Callable[[DataFrame], DataFrame]:
    """The history of a paged service: ``fetch`` names a function (chat, token) -> items, page_token, has_more.

    Items have message_id and ts (seconds). Executors fetch; a task holds the pages of one chat.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = named(fetch)
        for batch in batches:
            for chat, token in zip(batch.column("chat_id").to_pylist(), batch.column("token").to_pylist(), strict=True):
                found: list[dict] = []
                for _ in range(pages):
                    page = get(chat, token or "")
                    found += page.get("items", [])
                    token = page.get("page_token") if page.get("has_more") else None
                    if not token:
                        break
                found = found or [{}]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chat] * len(found)), pa.array([None if m.get("message_id") is None else str(m["message_id"]) for m in found], pa.string()),
                     pa.array([None if m.get("ts") is None else int(1_000_000 * m["ts"]) for m in found], pa.timestamp("us", "UTC")),
                     pa.array([json.dumps(m, ensure_ascii=False) for m in found]), pa.array([token or None] * len(found), pa.string())],
                    names=["chat_id", "message_id", "ts", "payload", "token"])

    return lambda chats: chats.select("chat_id", "token").repartition("chat_id").mapInArrow(run, HISTORY)


class Delivered:
    """The tables of a delivery, as of its last committed batch or of ``before``."""

    def __init__(self, spark: SparkSession, folder: str, before: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.commits = or_empty(spark, COMMIT, lambda: spark.read.schema(COMMIT).json(f"{self.folder}/commits"))
        if before is not None:
            self.commits = self.commits.where(F.col("batch") < before)

    def _batches(self, name: str, schema: str) -> DataFrame:
        rows = or_empty(self.spark, f"{schema}, batch LONG", lambda: self.spark.read.schema(f"{schema}, batch LONG").parquet(f"{self.folder}/{name}"))
        return rows.join(self.commits.select("batch"), "batch", "left_semi")

    def table(self, outcome: str) -> DataFrame:
        return self._batches(outcome, f"{MESSAGE}, origin STRING, watermark LONG")

    def ledger(self) -> DataFrame:
        """Each chat with where its history stands; the line of the latest batch counts."""
        lines = self._batches("ledger", "chat_id STRING, token STRING, status STRING")
        return lines.groupBy("chat_id").agg(F.max_by(F.struct("token", "status"), "batch").alias("_last")).select("chat_id", "_last.*")

    def latest(self) -> int | None:
        """The latest event time so far, in microseconds."""
        return self.commits.agg(F.max("latest")).first()[0]


def deliver_batch(batch: DataFrame, number: int, folder: str, history: Callable[[DataFrame], DataFrame], delay_seconds: int, bootstrap: bool) -> None:
    spark, base = batch.sparkSession, folder.rstrip("/")
    spark.conf.set("spark.sql.adaptive.enabled", "true")  # streams turn it off for the sake of their state; this one keeps none
    before = Delivered(spark, folder, number)
    latest = before.latest()
    watermark = None if latest is None else latest - 1_000_000 * delay_seconds
    first = latest is None
    rows = batch.select("chat_id", "message_id", "ts", "payload").dropDuplicates(["chat_id", "message_id"])

    def stage(name: str, out: DataFrame) -> DataFrame:
        """What several tables are made of, written so that it is worked out once."""
        path = f"{base}/staging/{name}"
        out.write.mode("overwrite").parquet(path)
        return spark.read.schema(out.schema).parquet(path)

    def write(name: str, out: DataFrame) -> int:
        seen = Observation()
        out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{base}/{name}/batch={number}")
        return seen.get["n"]

    ledger = before.ledger()
    routed = rows.join(ledger.select("chat_id", "status"), "chat_id", "left")
    if first and bootstrap:
        outcome = F.lit("seen")
    else:
        is_late = F.lit(False) if watermark is None else F.unix_micros(F.col("ts")) < watermark
        outcome = F.when(F.coalesce(F.col("status"), F.lit("open")) == "open", "backfill").when(is_late, "late").otherwise("live")
    routed = stage("routed", routed.withColumn("outcome", outcome).withColumn("origin", F.lit("feed")).withColumn("watermark", F.lit(watermark).cast("long")))
    columns = ["chat_id", "message_id", "ts", "payload", "origin", "watermark"]
    known = routed.where("status is null").select("chat_id").distinct()

    def fresh(out: DataFrame, *names: str) -> DataFrame:
        """Without the messages that an earlier batch wrote; only rows of the same span of event time are compared."""
        low, high = out.agg(F.min("ts"), F.max("ts")).first()
        if first or low is None:
            return out
        past = reduce(DataFrame.unionByName, [before.table(name).where(F.col("ts").between(F.lit(low), F.lit(high))).select("chat_id", "message_id") for name in names])
        return out.join(past, ["chat_id", "message_id"], "left_anti")

    of = lambda name: routed.where(F.col("outcome") == name).select(*columns)
    counts = {"seen": write("seen", of("seen")), "live": write("live", fresh(of("live"), "seen", "backfill", "live")), "late": write("late", fresh(of("late"), *OUTCOMES))}
    if first and bootstrap:
        counts["backfill"] = write("backfill", of("backfill"))
        write("ledger", known.select("chat_id", F.lit(None).cast("string").alias("token"), F.lit("done").alias("status")))
    else:
        opened = ledger.where("status = 'open'").select("chat_id", "token").unionByName(known.select("chat_id", F.lit("").alias("token")))
        pages = stage("pages", history(opened).select("chat_id", "message_id", "ts", "payload", "token"))
        old = pages.where("message_id is not null").select("chat_id", "message_id", "ts", "payload", F.lit("history").alias("origin"), F.lit(None).cast("long").alias("watermark"))
        # a message that the feed and the history both have is kept once, as the feed has it
        both = of("backfill").unionByName(old).groupBy("chat_id", "message_id").agg(F.min_by(F.struct(*columns[2:]), "origin").alias("_m")).select("chat_id", "message_id", "_m.*")
        counts["backfill"] = write("backfill", fresh(both, "seen", "backfill"))
        write("ledger", pages.groupBy("chat_id").agg(F.max("token").alias("token")).withColumn("status", F.when(F.col("token").isNull(), "done").otherwise("open")))
    newest = routed.agg(F.max(F.unix_micros(F.col("ts")))).first()[0]
    newest = max((t for t in (newest, latest) if t is not None), default=None)
    line = spark.createDataFrame([(number, newest, watermark, *(counts[o] for o in ("live", "late", "backfill", "seen")))], COMMIT)
    line.coalesce(1).write.mode("overwrite").json(f"{base}/commits/n={number}")


def deliver(feed: DataFrame, folder: str, history: Callable[[DataFrame], DataFrame], delay_seconds: int = 86_400, bootstrap: bool = False,
            once: bool = True) -> StreamingQuery:
    """Runs ``feed`` (chat_id, message_id, ts, payload) into the tables of ``folder``; see ``Delivered`` for reading them."""
    writer = feed.writeStream.foreachBatch(lambda batch, number: deliver_batch(batch, number, folder, history, delay_seconds, bootstrap))
    writer = writer.option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
