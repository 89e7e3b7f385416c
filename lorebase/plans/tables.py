"""Writers. Outputs are tables or sorted text parts; nothing is assembled on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_records(records: DataFrame, path: str) -> None:
    """Append-only record log, one folder per day and person."""
    records.write.mode("append").partitionBy("day", "person").json(path)


def overwrite_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_day_pages(page: DataFrame, path: str) -> None:
    """Fragments of day pages as text: one folder per day, parts in page order.

    Rows are range-partitioned by their place in the page, so a long day becomes several part files whose names sort
    in reading order.
    """
    ordered = page.repartitionByRange("day", "person", "part", "at").sortWithinPartitions("day", "person", "part", "at")
    ordered.select("day", "html").write.mode("overwrite").partitionBy("day").text(path)


def write_entries(entries: DataFrame, path: str) -> None:
    """Draft entries, one folder per entry id (each entry is a single small document)."""
    entries.select("entry_id", "entry").write.mode("overwrite").parquet(path)
