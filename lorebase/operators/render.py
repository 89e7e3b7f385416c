"""Pages as ordered fragments: manifest index, distillation digest, and the record of one question.

A page is never one string: rows of (group, at, part, html) are written sorted (``write_fragments``), so a section or notebook
of any size is many small pieces in several part files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import escape_html

HEAD, BODY, FOOT = 0, 1, 2
_END = (1 << 62) - 1


def _text(value: Column) -> Column:
    return escape_html(F.coalesce(value.cast("string"), F.lit("")))


def _items(values: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.concat(F.lit("<li>"), _text(v), F.lit("</li>"))), "")


def _grouped(rows: DataFrame, group: str, at: str, body: Column, head: Column, foot: str) -> DataFrame:
    """Fragments of rows, framed once per group; head and foot are made from one small row per group."""
    groups = rows.groupBy(group).agg(F.count("*").alias("n"))
    frame = [(HEAD, F.lit(-1), head), (FOOT, F.lit(_END), F.lit(foot))]
    out = rows.select(F.col(group).alias("section"), F.col(at).cast("long").alias("at"), F.lit(BODY).alias("part"), body.alias("html"))
    for part, place, html in frame:
        out = out.unionByName(groups.select(F.col(group).alias("section"), place.cast("long").alias("at"), F.lit(part).alias("part"), html.alias("html")))
    return out


def manifest_fragments(pages: DataFrame, order: str = "order") -> DataFrame:
    """The index of a notebook: per section a heading with its number of pages and a table row per page."""
    body = F.concat(F.lit("<tr><td>"), F.col(order), F.lit('</td><td><a href="'), _text(F.col("html")), F.lit('">'), _text(F.col("title")), F.lit("</a></td><td>"),
                    _text(F.col("updated")), F.lit("</td><td>"), _text(F.col("text_preview")), F.lit("</td></tr>"))
    head = F.concat(F.lit("<section><h2>"), _text(F.col("section")), F.lit(" ("), F.col("n"), F.lit(")</h2><table>"))
    return _grouped(pages, "section", order, body, head, "</table></section>")


def digest_fragments(pages: DataFrame, order: str, lists: Sequence[tuple[str, str]]) -> DataFrame:
    """A distillation to read: per section its pages with summary and lists. ``pages``: section, title, html, summary and the
    array columns of ``lists`` (column, heading); empty lists are left out."""
    parts = [F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"<h4>{heading}</h4><ul>"), _items(F.col(c)), F.lit("</ul>"))).otherwise("") for c, heading in lists]
    body = F.concat(F.lit("<article><h3>"), _text(F.col("title")), F.lit("</h3><p>"), _text(F.col("summary")), F.lit("</p>"), *parts,
                    F.lit('<p><a href="'), _text(F.col("html")), F.lit('">source</a></p></article>'))
    head = F.concat(F.lit("<section><h2>"), _text(F.col("section")), F.lit("</h2><p>"), F.col("n"), F.lit(" pages</p>"))
    return _grouped(pages, "section", order, body, head, "</section>")


def question_fragments(evidence: DataFrame, question: str, answer: str, order: str) -> DataFrame:
    """The record of one question: question and answer, then a card per piece of evidence. Evidence is a handful of rows."""
    body = F.concat(F.lit("<article><h3>"), _text(F.col("title")), F.lit("</h3><p>"), _text(F.col("section")), F.lit(" | score "), F.format_number(F.col("score"), 3), F.lit("</p><p>"),
                    _text(F.col("summary")), F.lit("</p><blockquote>"), _text(F.col("source_snippet")), F.lit("</blockquote></article>"))
    rows = evidence.select(F.lit(1).alias("section"), F.col(order).cast("long").alias("at"), F.lit(BODY).alias("part"), body.alias("html"))
    head = F.concat(F.lit("<!DOCTYPE html><html><body><h1>"), _text(F.lit(question)), F.lit("</h1><p>"), _text(F.lit(answer)), F.lit("</p>"))
    frame = evidence.sparkSession.range(1)
    return frame.select(F.lit(1).alias("section"), F.lit(-1).cast("long").alias("at"), F.lit(HEAD).alias("part"), head.alias("html")).unionByName(rows).unionByName(
        frame.select(F.lit(1).alias("section"), F.lit(_END).alias("at"), F.lit(FOOT).alias("part"), F.lit("</body></html>").alias("html")))


def write_fragments(fragments: DataFrame, path: str) -> None:
    """Text parts whose names sort in reading order."""
    order = ["section", "at", "part"]
    fragments.repartitionByRange(*order).sortWithinPartitions(*order).select("html").write.mode("overwrite").text(path)
