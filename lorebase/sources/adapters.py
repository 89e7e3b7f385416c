"""Canonical shapes for the supplied tables: documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions import html as H
from lorebase.functions.text import compact, redact, sha256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def document_sources(documents: DataFrame) -> DataFrame:
    """documents -> source documents; secrets are redacted before anything else sees the text."""
    return documents.select(
        F.col("doc_id").alias("ordinal"), F.concat(F.lit("doc:"), F.col("doc_id")).alias("source_id"),
        F.col("source").alias("source_type"), F.col("lang").alias("section"),
        compact(F.substring(redact(F.col("text")), 1, 80)).alias("title"), F.concat(F.lit("documents/"), F.col("doc_id")).alias("path"),
        redact(F.col("text")).alias("text"), F.lit("").alias("date"), F.lit("").alias("author"),
        F.create_map(F.lit("kind"), F.col("source")).alias("metadata"),
    )


def page_sources(pages: DataFrame) -> DataFrame:
    """pages -> source documents: section is the host, the text is that of the index extractor."""
    return pages.select(
        F.col("page_id").alias("ordinal"), F.concat(F.lit("page:"), F.col("page_id")).alias("source_id"),
        F.lit("source_html").alias("source_type"), host(F.col("url")).alias("section"), H.title(F.col("html")).alias("title"),
        F.col("url").alias("path"), redact(H.text_for_index(F.col("html"))).alias("text"), F.lit("").alias("date"),
        F.lit("").alias("author"), F.create_map(F.lit("source_sha256"), sha256(F.col("html"))).alias("metadata"),
    )


def conversation_sources(conversations: DataFrame) -> DataFrame:
    """conversations -> one source document per turn."""
    return conversations.select(
        (F.shiftleft(F.col("conv_id"), 32) + F.col("turn")).alias("ordinal"),
        F.concat_ws(":", F.lit("chat"), F.col("conv_id"), F.col("turn")).alias("source_id"),
        F.lit("chat").alias("source_type"), F.lit("Communication Records").alias("section"),
        F.concat(F.lit("Chat "), F.col("conv_id")).alias("title"), F.concat(F.lit("conversations/"), F.col("conv_id")).alias("path"),
        redact(F.col("text")).alias("text"), F.lit("").alias("date"), F.col("role").alias("author"),
        F.create_map(F.lit("kind"), F.lit("chat")).alias("metadata"),
    )


def host(url: F.Column) -> F.Column:
    return F.regexp_extract(url, r"^https?://([^/?#]+)", 1)


def url_path(url: F.Column) -> F.Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def manifest_pages(pages: DataFrame, closed: bool = False) -> DataFrame:
    """pages -> manifest rows of the HTML tree (title, hash, meta times, preview); ``closed`` as for ``decode_entities``."""
    meta = H.meta(F.col("html"))
    return pages.select(
        F.col("page_id").alias("ordinal"), host(F.col("url")).alias("section"), url_path(F.col("url")).alias("path"),
        H.title(F.col("html"), closed).alias("title"), F.col("url").alias("html"), sha256(F.col("html")).alias("sha256"),
        F.coalesce(F.try_element_at(meta, F.lit("X-Original-Page-Id")), F.lit("")).alias("onenote_page_id"),
        F.coalesce(F.try_element_at(meta, F.lit("X-Created-Time")), F.lit("")).alias("created"),
        F.coalesce(F.try_element_at(meta, F.lit("X-Updated-Time")), F.lit("")).alias("updated"),
        H.body_preview(F.col("html"), closed=closed).alias("text_preview"),
    )


def query_vector(embeddings: DataFrame, vec_id: int = 0) -> list[float]:
    """The vector a question is asked with: a one-row lookup, in place of an embedding call."""
    row = embeddings.filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else []
