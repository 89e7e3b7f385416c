"""Streams replayed over the landed events; each must give what the batch operator gives."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorebase.catalogue.registry import query
from lorebase.session import persist_table, shared_folder
from lorebase.sources.adapters import table
from lorebase.streaming import chats, delivery, feeds

_MESSAGE_ID = "user_id || ':' || json_extract_string(props, '$.k')"


def _feed(spark, folder):
    schema = table(spark, folder, "events").schema
    return feeds.file_feed(spark, folder, "events.parquet", schema)


@query("stream_dedupe_replay", f"SELECT DISTINCT {_MESSAGE_ID} AS message_id FROM events")
def stream_dedupe_replay(spark, folder):
    key = F.concat(F.col("user_id"), F.lit(":"), F.get_json_object("props", "$.k"))
    # an id may come back at any time of the month these events cover
    once = feeds.live_messages(_feed(spark, folder).select(key.alias("message_id"), F.col("ts").cast("timestamp").alias("ts")), "message_id", "ts", "40 days")
    return feeds.replay(once.select("message_id"), shared_folder(spark), "dedupe")


FILES = 6
_ARRIVALS = f"""
    span AS (SELECT min(epoch_us(ts)) AS t0, max(epoch_us(ts)) - min(epoch_us(ts)) + 1 AS width FROM events),
    arrived AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us, ({FILES} * (epoch_us(ts) - t0)) // width AS slice,
        least({FILES - 1}, ({FILES} * (epoch_us(ts) - t0)) // width + CASE WHEN event_id % 10 = 3 THEN 1 WHEN event_id % 17 = 5 THEN {{far}} ELSE 0 END) AS arrival,
        width // {FILES} // {{part}} // 1000000 AS delay FROM events, span)"""


def _arrivals(spark, folder, far, part):
    """The events with the file they arrive in: most in the file of their time, some one later, some ``far`` later; and the
    length of a file's time, over ``part``, in seconds."""
    events = table(spark, folder, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    t0, t1 = events.agg(F.min("at"), F.max("at")).first()
    width = t1 - t0 + 1
    slice_ = F.expr(f"({FILES} * (at - {t0})) div {width}")
    behind = F.when(F.col("event_id") % 10 == 3, 1).when(F.col("event_id") % 17 == 5, far).otherwise(0)
    return events.withColumn("slice", slice_).withColumn("arrival", F.least(F.lit(FILES - 1), slice_ + behind)), width // FILES // part // 1_000_000, t1


def _chats_replay(spark, folder, stream, label):
    """Six files land one after the other, a tenth of the messages one file late; then a heartbeat closes the feed."""
    rows, delay, last = _arrivals(spark, folder, 1, 1)
    command = F.when(F.col("event_type") == "signup", "record_on").when(F.col("event_type") == "purchase", "record_off")
    feed = rows.select(F.col("user_id").cast("long").alias("chat_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), command.alias("command"), "arrival")
    base = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    feeds.land(feed, f"{base}/in", "arrival", FILES)
    beat = spark.range(1).select(F.lit(-1).cast("long").alias("chat_id"), F.lit(None).cast("long").alias("event_id"),
                                 F.timestamp_micros(F.lit(last + 1_000_000 * (delay + 7200))).alias("ts"), F.lit(None).cast("string").alias("command"), F.lit(0).alias("arrival"))
    feeds.land(beat, f"{base}/in", "arrival", 1)
    landed = feeds.file_feed(spark, f"{base}/in", "*.parquet", feed.drop("arrival").schema, 1)
    with chats.keyed_state(spark, spark.sparkContext.defaultParallelism):
        feeds.write_table(stream(landed, f"{delay + 1} seconds"), f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/table")


@query("stream_modes_replay", """
    SELECT event_id, coalesce(last_value(CASE event_type WHEN 'signup' THEN 'record' WHEN 'purchase' THEN 'ask' END IGNORE NULLS) OVER
        (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'ask') AS mode FROM events""")
def stream_modes_replay(spark, folder):
    return _chats_replay(spark, folder, chats.modes, "modes").select("event_id", "mode")


@query("stream_context_replay", """
    WITH t AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
    SELECT a.event_id, count(b.event_id)::INT AS context_turns FROM t a LEFT JOIN t b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 6 AND a.n - 1
        AND a.s - b.s <= 1800 GROUP BY a.event_id""")
def stream_context_replay(spark, folder):
    return _chats_replay(spark, folder, chats.contexts, "context").select("event_id", "context_turns")


_PAGE, _PAGES = 5, 2


@query("stream_delivery_replay", f"""
    WITH {_ARRIVALS.format(far=3, part=2)},
    fed AS (SELECT *, user_id % 4 = 0 AS joined FROM arrived WHERE user_id % 4 <> 0 OR slice >= 3),
    history AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS n FROM arrived WHERE user_id % 4 = 0 AND slice < 3),
    met AS (SELECT user_id, min(arrival) AS met FROM fed GROUP BY 1),
    pages AS (SELECT met.user_id, met, greatest(1, ceil(count(event_id) / {_PAGE * _PAGES}.0)) AS batches FROM met LEFT JOIN history USING (user_id) GROUP BY 1, 2),
    marks AS (SELECT a.arrival, max(b.us) - 1000000 * max(b.delay) AS mark FROM (SELECT DISTINCT arrival FROM fed) a LEFT JOIN fed b ON b.arrival < a.arrival GROUP BY 1)
    SELECT event_id, 'feed' AS origin, CASE WHEN arrival = 0 THEN 'seen' WHEN met > 0 AND arrival < met + batches THEN 'backfill' WHEN us < mark THEN 'late' ELSE 'live' END AS outcome
    FROM fed JOIN pages USING (user_id) JOIN marks USING (arrival)
    UNION ALL SELECT event_id, 'history', 'backfill' FROM history JOIN pages USING (user_id) WHERE met > 0 AND n <= {_PAGE * _PAGES} * ({FILES} - met)""")
def stream_delivery_replay(spark, folder):
    """A feed from its first poll on: the first file only marks what is there; a quarter of the chats let the connector in halfway,
    with a history that takes several batches; a seventeenth of the messages come three files late."""
    rows, delay, _ = _arrivals(spark, folder, 3, 2)
    message = [F.col("user_id").cast("string").alias("chat_id"), F.col("event_id").cast("string").alias("message_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("payload")]
    joined = F.col("user_id") % 4 == 0
    base = f"{shared_folder(spark).rstrip('/')}/delivery-{uuid.uuid4().hex}"
    feeds.land(rows.where(~joined | (F.col("slice") >= 3)).select(*message, "arrival"), f"{base}/in", "arrival", FILES)
    newest = Window.partitionBy("chat_id").orderBy(F.desc("ts"), F.desc(F.col("message_id").cast("long")))
    archive = rows.where(joined & (F.col("slice") < 3)).select(*message).withColumn("_n", F.row_number().over(newest)).withColumn("_most", F.count("*").over(Window.partitionBy("chat_id")))
    archive = persist_table(archive, "archive")  # numbered once, read by every batch

    def history(chats_open):
        """Pages of an archived table: the token is the number of messages already given."""
        wanted = chats_open.select("chat_id", F.coalesce(F.expr("try_cast(nullif(token, '') AS INT)"), F.lit(0)).alias("_from"))
        given = (F.col("_n") > F.col("_from")) & (F.col("_n") <= F.col("_from") + _PAGE * _PAGES)
        pages = wanted.join(archive.withColumnRenamed("chat_id", "_chat"), (F.col("chat_id") == F.col("_chat")) & given, "left")
        token = F.when(F.col("_from") + _PAGE * _PAGES < F.col("_most"), (F.col("_from") + _PAGE * _PAGES).cast("string"))
        return pages.select("chat_id", "message_id", "ts", "payload", token.alias("token"))

    landed = feeds.file_feed(spark, f"{base}/in", "*.parquet", delivery.MESSAGE, 1)
    delivery.deliver(landed, f"{base}/out", history, delay, bootstrap=True).awaitTermination()
    out = delivery.Delivered(spark, f"{base}/out")
    tables = [out.table(o).select(F.col("message_id").cast("long").alias("event_id"), "origin", F.lit(o).alias("outcome")) for o in delivery.OUTCOMES]
    return reduce(lambda a, b: a.unionByName(b), tables)


@query("stream_day_replay", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS records FROM events GROUP BY 1, 2""")
def stream_day_replay(spark, folder):
    """Every batch gives the counts of the days that it touched; the last ones count, so the open day is there as well."""
    feed = _feed(spark, folder).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    days = feeds.replay_latest(feeds.day_counts(feed, "ts", "0 seconds", "kind"), shared_folder(spark), "days", "day", "kind")
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "kind", "records")
