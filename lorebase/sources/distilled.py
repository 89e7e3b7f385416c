"""Distilled pages as index sources: the distillation as labelled text, and the page's own HTML beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions import html as H
from lorebase.functions.text import compact, is_blank, redact, sha256

#: list fields of a distillation, with the label each has in the searched text
LISTS = (
    ("what_happened", "What happened:\n"), ("important_facts", "Important facts:\n"),
    ("decisions_or_conclusions", "Decisions or conclusions:\n"), ("open_questions_or_next_steps", "Open questions or next steps:\n"),
    ("people_organizations_equipment", "People, organizations, equipment:\n"), ("tags", "Tags: "),
)


def _lines(values: Column, flat: bool = False) -> Column:
    return F.coalesce(F.array_join(F.transform(values, compact) if flat else values, "\n"), F.lit(""))


def distilled_text() -> Column:
    """The ten labelled fields of a distilled page, redacted; expects the columns of a flattened distillation."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    head = [F.concat(F.lit("Section: "), text("section")), F.concat(F.lit("Title: "), text("title")), F.concat(F.lit("Summary: "), text("distilled.one_sentence_summary"))]
    lists = [F.concat(F.lit(label), _lines(F.col(f"distilled.{name}"))) for name, label in LISTS]
    return redact(F.concat_ws("\n\n", *head, *lists, F.concat(F.lit("Attachments: "), _lines(F.col("attachments")))))


def distillation_sources(pages: DataFrame, html_files: DataFrame | None = None) -> DataFrame:
    """One source document per distilled page; where ``html_files`` (rel, text) has the page, its own text as a second one.

    The distillation travels in the metadata, an entry per field with an item per line, so that evidence can show it.
    """
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled"))
    section, sha = F.coalesce("section", F.lit("")), F.coalesce("source_sha256", F.lit(""))
    identity = F.concat_ws("/", section, title, F.coalesce(F.nullif(sha, F.lit("")), F.col("html"), F.lit("None")))
    date = F.coalesce(F.nullif(F.col("updated"), F.lit("")), F.nullif(F.col("created"), F.lit("")), F.lit(""))
    origin = [F.lit("source_sha256"), sha, F.lit("attachments"), _lines(F.col("attachments"), True)]
    fields = [x for name, _ in LISTS for x in (F.lit(name), _lines(F.col(f"distilled.{name}"), True))]
    summary = F.coalesce("distilled.one_sentence_summary", F.lit(""))

    def source(kind: str, source_id: Column, metadata: list[Column], text: Column) -> list[Column]:
        return [F.xxhash64(source_id).alias("ordinal"), source_id.alias("source_id"), F.lit(kind).alias("source_type"), section.alias("section"), title.alias("title"),
                F.coalesce("html", F.lit("")).alias("path"), text.alias("text"), date.alias("date"), F.lit("").alias("author"), F.create_map(*metadata).alias("metadata")]

    own_id = F.concat(F.lit("distilled:"), sha256(identity, rules.DISTILLED_ID_HEX))
    out = pages.select(*source("distilled_page", own_id, [*origin, F.lit("one_sentence_summary"), summary, *fields], distilled_text()))
    if html_files is None:
        return out
    read = html_files.select(F.col("rel").alias("_rel"), F.col("text").alias("_html"))
    html_id = F.concat(F.lit("html:"), sha256(F.col("html"), rules.DISTILLED_ID_HEX))
    found = pages.join(read, F.col("html") == F.col("_rel"))
    raw = found.select(*source("source_html", html_id, origin, redact(H.text_for_index(F.col("_html"))))).where(~is_blank(F.col("text")))
    return out.unionByName(raw)
