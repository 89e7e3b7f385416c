"""Message feeds with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

POLL_SECONDS = 5


def file_feed(spark: SparkSession, folder: str, name: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """Landed parquet files as a stream (push feeds land their events as files)."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def live_messages(feed: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each message id once. State is kept for ``delay``, in place of a bounded list of ids."""
    return feed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def day_counts(feed: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    """Records per calendar day. In append mode a day comes once, when the watermark has passed it; in update mode every
    batch gives the new counts of the days it touched, the open one included."""
    window = F.window(F.col(time), "1 day")
    return feed.withWatermark(time, delay).groupBy(window, *keys).agg(F.count("*").alias("records")).select(
        F.col("window.start").alias("day"), *keys, "records"
    )


def land(rows: DataFrame, folder: str, arrival: str, files: int) -> None:
    """Rows as landed files, one after the other along ``arrival`` (0 to files - 1), as a connector would leave them.

    All tasks look for the rows of a file; only writing it is one task's.
    """
    for n in range(files):
        rows.where(F.col(arrival) == n).drop(arrival).repartition(1).write.mode("append").parquet(folder)


def write_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Append a stream to a parquet table; ``once`` handles what is there and stops, else it polls."""
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{POLL_SECONDS} seconds")
    return writer.start()


def replay_latest(stream: DataFrame, folder: str, label: str, *keys: str) -> DataFrame:
    """Run a stream in update mode over everything that has landed; of each key the row of its last batch."""
    import uuid

    base = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table/batch={number}")  # a repeated batch writes the same again

    writer = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{base}/table")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")


def replay(stream: DataFrame, folder: str, label: str) -> DataFrame:
    """Run a stream over everything that has landed and read the result table."""
    import uuid

    base = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    write_table(stream, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return stream.sparkSession.read.parquet(f"{base}/table")
