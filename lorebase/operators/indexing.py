"""From source documents to the chunk index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions import text as T
from lorebase.functions.chunking import export_chunks, paragraph_chunks
from lorebase.operators.grouping import TEXTS_PER_BLOCK, numbered_within


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources with a non-blank text, columns matched by name."""
    return reduce(DataFrame.unionByName, sources).filter(~T.is_blank(F.col("text")))


def chunk_sources(sources: DataFrame) -> DataFrame:
    """One row per chunk with content-derived ids. Narrow: no shuffle, one pass over the text.

    Chunks with fewer than 30 characters after white-space collapse are left out but keep their number.
    """
    def clean(pieces: F.Column) -> F.Column:
        # a cut can lay bare a secret, so pieces are redacted again; a text without any clue has no such piece
        cleaned = F.transform(pieces, lambda piece: T.apply_rules(piece, rules.INDEX_REDACTION))
        return F.when(T.suspicious(F.col("text")), cleaned).otherwise(pieces)

    pieces = T.bind(paragraph_chunks(F.col("text")), clean)
    exploded = sources.select(
        "ordinal", "source_id", "source_type", "section", "title", "path", "date", "author",
        T.sha256(F.col("text")).alias("source_hash"),
        T.redact_map(F.col("metadata")).alias("metadata"),
        F.posexplode(pieces).alias("position", "text"),
    )
    def long_enough(text: F.Column) -> F.Column:
        return F.length(T.compact(text)) >= rules.CHUNK_MIN

    # the beginning decides for nearly every chunk; only the others are looked at as a whole
    start = F.substring("text", 1, 4 * rules.CHUNK_MIN)
    return (
        exploded.filter(long_enough(start) | long_enough(F.col("text")))
        .withColumn("chunk_index", F.col("position") + 1)
        .withColumn("text_hash", T.sha256(F.col("text")))
        .withColumn("chunk_id", T.chunk_id(F.col("source_id"), F.col("chunk_index"), F.col("text_hash")))
        .drop("position")
    )


def embedding_input(limit: int | None = None) -> F.Column:
    """Header and text a chunk is embedded from; ``limit`` is what the embedding service accepts."""
    header = [
        F.concat(F.lit(label + ": "), F.coalesce(F.col(name), F.lit("")))
        for label, name in (("Section", "section"), ("Title", "title"), ("Source type", "source_type"), ("Date", "date"))
    ]
    whole = F.concat(F.concat_ws("\n", *header), F.lit("\n\n"), F.col("text"))
    return F.substring(whole, 1, limit) if limit else whole


def known_vectors(old_index: DataFrame) -> DataFrame:
    """text_hash -> vector of the previous index, one row per hash."""
    return (
        old_index.filter(F.col("vector").isNotNull() & F.col("text_hash").isNotNull())
        .groupBy("text_hash")
        .agg(F.max_by("vector", "ordinal").alias("vector"))
    )


def reuse_vectors(chunks: DataFrame, old_index: DataFrame | None) -> DataFrame:
    """Chunks with the vector their text already had, null where it has to be embedded.

    The right side has one row per hash, so a text copied millions of times only makes its left partition
    large, which AQE splits. Spark broadcasts the right side when its size is under the threshold.
    """
    if old_index is None:
        return chunks.withColumn("vector", F.lit(None).cast("array<float>"))
    return chunks.join(known_vectors(old_index), "text_hash", "left")


def reuse_counts(chunks: DataFrame, old_index: DataFrame) -> DataFrame:
    """Chunk and reuse counters. Copies are counted per hash before the join."""
    per_hash = chunks.groupBy("text_hash").agg(F.count("*").alias("copies"))
    known = old_index.select("text_hash").distinct().withColumn("known", F.lit(1))
    joined = per_hash.join(known, "text_hash", "left")
    return joined.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("chunk_count"),
        F.count("*").alias("distinct_texts"),
        F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("copies"))), F.lit(0)).alias("reused_vectors"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("copies"))), F.lit(0)).alias("missing_vectors"),
    )


def index_manifest(index: DataFrame) -> DataFrame:
    """One row of counters over a finished index; expects ``reused`` next to the chunk columns."""
    has_vector = F.col("vector").isNotNull()
    return index.agg(
        F.count_distinct("source_id").alias("source_count"),
        F.count("*").alias("chunk_count"),
        F.count_if(has_vector).alias("chunks_with_vectors"),
        F.count_if(F.col("reused")).alias("reused_vectors"),
        F.count_if(has_vector & ~F.col("reused")).alias("embedded_chunks"),
    )


def content_copies(sources: DataFrame) -> DataFrame:
    """Texts that occur more than once: hash, copies, first ordinal. Aggregates before it shuffles."""
    return (
        sources.groupBy(T.sha256(F.col("text")).alias("source_hash"))
        .agg(F.count("*").alias("copies"), F.min("ordinal").alias("first_ordinal"))
        .filter(F.col("copies") > 1)
    )


def export_entries(files: DataFrame, day: str, ordinals_per_block: int = TEXTS_PER_BLOCK) -> DataFrame:
    """Draft entries of imported files: one per 5000-character piece, with front matter and body.

    ``files``: ordinal, name, archived (path of the archived copy), source_hash, text. Two pieces that would get the same
    entry id are told apart by a running suffix. ``ordinals_per_block`` is wider for ordinals that are not dense.
    """
    pieces = files.withColumn("pieces", export_chunks(F.col("text"))).select(
        "ordinal", "name", "archived", "source_hash", F.size("pieces").alias("chunk_total"),
        F.posexplode("pieces").alias("position", "chunk"),
    )
    number = F.col("position") + 1
    base = F.concat(F.lit(f"{day}-"), T.slug_import(T.stem(F.col("name"))))
    part = F.concat(F.lit("-part-"), F.lpad(number.cast("string"), 3, "0"))
    title = F.concat(
        T.stem(F.col("name")),
        F.when(F.col("chunk_total") > 1, F.concat(F.lit(" part "), number, F.lit("/"), F.col("chunk_total"))).otherwise(""),
    )
    drafts = pieces.select(
        F.when(F.col("chunk_total") > 1, F.concat(base, part)).otherwise(base).alias("wanted_id"),
        "ordinal", "name", "archived", "source_hash", "chunk_total", number.alias("chunk_index"), title.alias("title"), "chunk",
        F.substring(T.compact(F.col("chunk")), 1, 180).alias("preview"),
    )
    block = F.floor(F.col("ordinal") / ordinals_per_block)
    unique = numbered_within(drafts, ["wanted_id"], ["ordinal", "chunk_index"], block, "clash").withColumn(
        "entry_id",
        F.when(F.col("clash") == 1, F.col("wanted_id")).otherwise(F.concat("wanted_id", F.lit("-"), F.col("clash"))),
    )
    front = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("id: "), F.col("entry_id")),
        F.concat(F.lit('title: "'), T.escape_quotes(F.col("title")), F.lit('"')),
        F.lit("type: notebook_page"), F.lit("status: draft"), F.lit(f"date: {day}"), F.lit("projects: []"),
        F.lit("people: []"), F.lit('tags: ["onenote-export", "needs-review"]'),
        F.concat(F.lit("source_refs: "), T.quoted_list(F.array("archived"))), F.lit("confidence: medium"),
        F.concat(F.lit("source_hash: "), F.col("source_hash")), F.concat(F.lit("chunk_index: "), F.col("chunk_index")),
        F.concat(F.lit("chunk_total: "), F.col("chunk_total")),
        F.concat(F.lit('summary: "'), T.escape_quotes(F.col("preview")), F.lit('"')), F.lit("---"), F.lit(""),
    )
    body = F.concat_ws(
        "\n", F.lit(""), F.lit("## Imported Source"), F.lit(""), F.concat(F.lit("- Original file: `"), F.col("name"), F.lit("`")),
        F.concat(F.lit("- Archived source: `"), F.col("archived"), F.lit("`")),
        F.concat(F.lit("- Chunk: "), F.col("chunk_index"), F.lit(" of "), F.col("chunk_total")),
        F.lit(""), F.lit("## Extracted Text"), F.lit(""), F.col("chunk"), F.lit(""),
    )
    return unique.select("entry_id", "title", "chunk_index", "chunk_total", "preview", F.concat(front, body).alias("entry"))


def archive_name(name: F.Column, source_hash: F.Column, day: str) -> F.Column:
    """``day-slug-hash.ext`` of an imported file."""
    return F.concat(
        F.lit(f"{day}-"), T.slug_import(T.stem(name)), F.lit("-"),
        F.substring(source_hash, 1, rules.ARCHIVE_HASH_HEX), T.suffix(name),
    )
