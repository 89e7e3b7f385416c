"""Mail: parsed messages, deduplication against the mail state, search documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions import html as H
from lorebase.functions.text import base_name, is_blank, redact, sha256, slug_mail
from lorebase.functions.values import first_address, iso, mail_time
from lorebase.operators.grouping import first_per_key
from lorebase.operators.noise import is_index_noise
from lorebase.sources.binaries import mail_attachments, mail_parts
from lorebase.sources.chat import file_summary

FILES = "array<struct<file_name:string,path:string,mime_type:string,size:bigint,sha256:string,classification:string,text_preview:string,text_extract:string>>"


def mail_records(binaries: DataFrame) -> DataFrame:
    """path, uid, content of raw mails -> records. The body is the plain part, else the HTML part as text."""
    parsed = binaries.select("path", "uid", mail_parts(F.col("content")).alias("m"), mail_attachments(F.col("content")).alias("a"))
    files = F.transform("a", lambda f: F.struct(
        f["file_name"], F.concat(F.col("path"), F.lit("/"), f["file_name"]).alias("path"), f["mime_type"], f["size"], f["sha256"], F.lit("").alias("classification"),
        F.substring(F.coalesce(f["text"], F.lit("")), 1, 2000).alias("text_preview"), f["text"].alias("text_extract")))
    body = F.when(F.col("m.plain") != "", F.col("m.plain")).otherwise(H.text_for_mail(F.col("m.html")))
    records = parsed.select("path", "uid", "m.message_id", iso(mail_time(F.col("m.date"))).alias("date"), F.col("m.from").alias("from"),
                            "m.to", "m.cc", "m.subject", body.alias("body"), files.cast(FILES).alias("attachments"))
    sender = first_address(F.col("from"))
    return records.withColumns({
        "sender": sender, "sender_folder": slug_mail(sender, "unknown_sender"), "text_preview": F.substring("body", 1, 2000),
    })


def new_mail(records: DataFrame, processed_uids: DataFrame, processed_message_ids: DataFrame, ignored_senders: DataFrame) -> DataFrame:
    """Adds action: ``archive`` for new mail, ``ignored`` for muted senders, ``known`` for message ids seen before.

    All three count as processed. Mail whose uid is processed is left out; a message id that repeats within the
    batch is archived once, under its lowest uid.
    """
    fresh = records.join(processed_uids.select("uid").distinct(), "uid", "left_anti")
    muted = ignored_senders.select(F.col("sender")).distinct().withColumn("_muted", F.lit(True))
    known = processed_message_ids.select("message_id").distinct().withColumn("_known", F.lit(True))
    marked = fresh.join(muted, "sender", "left").join(known, "message_id", "left")
    first = first_per_key(
        marked.filter((F.col("message_id") != "") & F.col("_muted").isNull()).select("message_id", F.col("uid").alias("_first")),
        ["message_id"], ["_first"],
    )
    repeated = (F.col("message_id") != "") & (F.col("uid") != F.col("_first"))
    action = F.when(F.col("_muted"), "ignored").when(F.col("_known") | F.coalesce(repeated, F.lit(False)), "known").otherwise("archive")
    return marked.join(first, "message_id", "left").withColumn("action", action).drop("_muted", "_known", "_first")


def _files(records: DataFrame) -> Column:
    """The attachments of records; tables of mails without any may lack the column."""
    return F.coalesce("attachments", F.array().cast(FILES)) if "attachments" in records.columns else F.array().cast(FILES)


def _gated(records: DataFrame, hints: Sequence[str], noise: Sequence[str]) -> DataFrame:
    """Records with ``_subject`` and the text they are searched in, noise left out."""
    subject = F.when(F.coalesce("subject", F.lit("")) == "", "(no subject)").otherwise(F.col("subject"))
    text = F.concat_ws(
        "\n", F.lit("Source: email"), F.concat(F.lit("Date: "), F.coalesce("date", F.lit(""))),
        F.concat(F.lit("From: "), F.col("from")), F.concat(F.lit("Subject: "), subject),
        F.concat(F.lit("Preview:\n"), F.coalesce("text_preview", F.lit(""))), F.concat(F.lit("Body:\n"), F.coalesce("body", F.lit(""))),
        F.concat(F.lit("Attachments:\n"), file_summary(_files(records))),
    )
    return records.withColumn("_subject", subject).withColumn("_text", text).where(~is_index_noise(F.col("_text"), hints, noise))


def mail_sources(records: DataFrame, hints: Sequence[str] = rules.INDEX_HINTS, noise: Sequence[str] = rules.INDEX_NOISE) -> DataFrame:
    """Archived mail records -> source documents with a summary of their attachments; noise is left out."""
    built = _gated(records, hints, noise)
    return built.select(
        F.xxhash64("path", "message_id").alias("ordinal"),
        F.concat(F.lit("email:"), sha256(F.concat("path", "message_id"), rules.RECORD_ID_HEX)).alias("source_id"),
        F.lit("email").alias("source_type"), F.lit(rules.RECORD_SECTION).alias("section"), redact(F.col("_subject")).alias("title"), "path",
        redact(F.col("_text")).alias("text"), F.coalesce("date", F.lit("")).alias("date"), F.col("from").alias("author"),
        F.create_map(F.lit("kind"), F.lit("email")).alias("metadata"),
    )


def mail_attachment_sources(records: DataFrame, hints: Sequence[str] = rules.INDEX_HINTS, noise: Sequence[str] = rules.INDEX_NOISE) -> DataFrame:
    """The readable attachments of the mails that become sources, each a document of its own; blank extracts give no row."""
    each = _gated(records, hints, noise).select("path", "date", "from", F.posexplode(_files(records)).alias("at", "file")).where(~is_blank(F.coalesce("file.text_extract", F.lit(""))))
    path = F.coalesce(F.nullif("file.path", F.lit("")), F.col("path"))
    identity = F.concat(path, F.col("at").cast("string"))
    return each.select(
        F.xxhash64(identity).alias("ordinal"), F.concat(F.lit("email-file:"), sha256(identity, rules.RECORD_ID_HEX)).alias("source_id"),
        F.lit("email_file_text").alias("source_type"), F.lit(rules.ATTACHMENT_SECTION).alias("section"),
        F.coalesce(F.nullif("file.file_name", F.lit("")), base_name(path)).alias("title"), path.alias("path"), redact(F.col("file.text_extract")).alias("text"),
        F.coalesce("date", F.lit("")).alias("date"), F.col("from").alias("author"),
        F.create_map(F.lit("parent_record"), F.col("path"), F.lit("mime_type"), F.coalesce("file.mime_type", F.lit(""))).alias("metadata"),
    )
