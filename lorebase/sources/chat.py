"""Chat archives -> source documents, and the adapters of polled messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions.intent import file_items, is_mentioned, message_text
from lorebase.functions.text import base_name, redact, sha256
from lorebase.functions.values import epoch_iso
from lorebase.operators.noise import is_index_noise


def file_summary(files: F.Column) -> F.Column:
    """One ``name=value; ...`` line per file, empty values left out."""
    def line(item: F.Column) -> F.Column:
        name = F.coalesce(F.nullif(item["file_name"], F.lit("")), base_name(F.coalesce(item["path"], F.lit(""))))
        pairs = [("file_name", name)] + [(k, item[k]) for k in ("mime_type", "classification", "path", "text_preview")]
        return F.concat_ws("; ", *[
            F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(key + "="), value)) for key, value in pairs
        ])

    return F.array_join(F.transform(files, line), "\n")


def chat_sources(records: DataFrame, channel: str, hints: Sequence[str] = rules.INDEX_HINTS,
                 noise: Sequence[str] = rules.INDEX_NOISE) -> DataFrame:
    """Records with day, person, record_path and line (position in the file) -> source documents.

    Kinds that are no memory are dropped before any text is put together; noise is dropped after.
    """
    kinds = records.filter(F.col("kind").isin(*rules.CHANNEL_KINDS[channel]))
    files = F.coalesce("files", F.array().cast(records.schema["files"].dataType))
    date = F.coalesce(F.nullif(F.col("created_at"), F.lit("")), F.col("day"))
    text = F.concat_ws(
        "\n", F.lit(f"Source: {channel}"), F.concat(F.lit("Date: "), date), F.concat(F.lit("Person: "), F.col("person")),
        F.concat(F.lit("Kind: "), F.col("kind")), F.concat(F.lit("Text:\n"), F.coalesce("text", F.lit(""))),
        F.concat(F.lit("Files:\n"), file_summary(files)),
    )
    identity = F.concat(F.col("record_path"), F.coalesce(F.col("message_id"), F.lit("None")), F.col("line").cast("string"))
    built = kinds.select("*", text.alias("_text"))
    return built.filter(~is_index_noise(F.col("_text"), hints, noise)).select(
        F.xxhash64(identity).alias("ordinal"),
        F.concat(F.lit(f"{channel}:"), sha256(identity, rules.RECORD_ID_HEX)).alias("source_id"),
        F.lit(channel).alias("source_type"), F.lit(rules.RECORD_SECTION).alias("section"),
        F.concat_ws(" ", F.lit(channel.title()), F.col("day"), F.col("person")).alias("title"),
        F.col("record_path").alias("path"), redact(F.col("_text")).alias("text"), date.alias("date"),
        F.col("person").alias("author"), F.create_map(F.lit("kind"), F.col("kind")).alias("metadata"),
    )


def attachment_sources(records: DataFrame, extracts: DataFrame, channel: str) -> DataFrame:
    """Text extracts of record files as source documents of their own; files without an extract give no row."""
    files = records.select("record_path", "created_at", "day", "person", F.posexplode("files").alias("at", "file"))
    known = files.withColumn("extract_path", F.col("file.text_extract")).join(extracts, "extract_path")
    path = F.coalesce(F.nullif(F.col("file.path"), F.lit("")), F.col("extract_path"))
    name = F.coalesce(F.nullif(F.col("file.file_name"), F.lit("")), base_name(path))
    identity = F.concat(path, F.col("at").cast("string"))
    return known.select(
        F.xxhash64(identity).alias("ordinal"),
        F.concat(F.lit(f"{channel}-file:"), sha256(identity, rules.RECORD_ID_HEX)).alias("source_id"),
        F.lit(f"{channel}_file_text").alias("source_type"), F.lit(rules.ATTACHMENT_SECTION).alias("section"), name.alias("title"),
        path.alias("path"), redact(F.col("extract")).alias("text"),
        F.coalesce(F.nullif(F.col("created_at"), F.lit("")), F.col("day")).alias("date"), F.col("person").alias("author"),
        F.create_map(F.lit("parent_record"), F.col("record_path")).alias("metadata"),
    )


def polled_records(messages: DataFrame, bot_id: str, bot_names: Sequence[str]) -> DataFrame:
    """Polled REST messages -> records: text without mentions, file item, sender ids, times, mentioned flag.

    Messages sent by apps and system messages are dropped.
    """
    content, kind = F.col("body.content"), F.col("msg_type")
    people = messages.filter((F.lower(F.coalesce("sender.sender_type", F.lit(""))) != "app") & (F.lower("msg_type") != "system"))
    return people.select(
        "message_id", "chat_id", F.when(F.col("chat_type").isin("p2p", "group"), F.col("chat_type")).otherwise("group").alias("chat_type"),
        kind.alias("message_type"), message_text(content, kind, F.col("mentions")).alias("text"),
        file_items(content, kind, F.col("message_id")).alias("files"),
        F.when(F.col("sender.id_type") == "open_id", F.col("sender.id")).otherwise("").alias("open_id"),
        F.when(F.col("sender.id_type") == "user_id", F.col("sender.id")).otherwise("").alias("user_id"),
        F.col("create_time").alias("original_create_time"), epoch_iso(F.col("create_time")).alias("original_created_at"),
        is_mentioned(F.col("mentions"), bot_id, bot_names).alias("mentioned"),
    )
