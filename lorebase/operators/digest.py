"""Daily digests: budgets, compact records, per-day summaries, rendered fragments and entry checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions.text import escape_html
from lorebase.operators.grouping import with_prefix
from lorebase.session import persist_table


def _fitting(records: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, size: Column, limit: int) -> DataFrame:
    """``records`` with ``prefix``, as far as the budget goes.

    Only keys, order and sizes are summed up; what fits is a short table, so the texts are fetched by a join on keys and
    order (which have to name a row) that leaves them where they are while Spark can broadcast that table.
    """
    sizes = records.select(*keys, *order, block.alias("_at"), size.alias("_size"))
    fitting = with_prefix(sizes, keys, order, F.col("_at"), F.col("_size"), "prefix", limit)
    return records.join(persist_table(fitting.select(*keys, *order, "prefix"), "fitting"), [*keys, *order])


def within_budget(
    records: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, header: Column, text: Column,
    limit: int, cut_header: bool = False,
) -> DataFrame:
    """Blocks of ``header + text`` in order until ``limit`` characters per key are used up; adds prefix and block.

    The block that crosses the limit is cut. Mail cuts the whole block (``cut_header``), chat channels cut only the
    text, so their header may run over the limit. Rows past the limit are left out.
    """
    left = F.lit(limit) - F.col("prefix")
    whole = F.concat(header, text)
    cut = F.substring(whole, F.lit(1), left) if cut_header else F.concat(header, F.substring(text, F.lit(1), left))
    return _fitting(records, keys, order, block, F.length(header) + F.length(text), limit).withColumn("block", cut)


def doc_budget(
    docs: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, text: Column,
    is_log: Column, per_file: int = rules.SELF_DOC_FILE_CHARS, total: int = rules.SELF_DOC_TOTAL_CHARS,
) -> DataFrame:
    """Adds ``included`` (text as shown) and ``included_chars``: at most ``per_file`` characters of a file, the tail
    for a log, and ``total`` characters per key; cuts are marked."""
    over = F.length(text) > per_file
    tail, cut_off = "[TRUNCATED: latest work-log tail only]\n", f"\n\n[TRUNCATED after {per_file} chars]"
    shown = (
        F.when(over & is_log, F.concat(F.lit(tail), F.right(text, F.lit(per_file))))
        .when(over, F.concat(F.substring(text, 1, per_file), F.lit(cut_off)))
        .otherwise(text)
    )
    size = F.when(over & is_log, F.lit(len(tail) + per_file)).when(over, F.lit(per_file + len(cut_off))).otherwise(F.length(text))
    fitting = _fitting(docs, keys, order, block, size, total).withColumn("_shown", shown)
    left = F.lit(total) - F.col("prefix")
    cut = F.concat(F.substring(F.col("_shown"), F.lit(1), left), F.lit("\n\n[TRUNCATED by total prompt budget]"))
    fitted = F.when(F.length("_shown") > left, cut).otherwise(F.col("_shown"))
    return fitting.withColumn("included", fitted).withColumn("included_chars", F.length("included")).drop("_shown")


def day_summary(records: DataFrame, day: Column, person: Column, files: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Records, people and files per day (and further keys), partially aggregated before the shuffle."""
    return records.groupBy(day.alias("day"), *keys).agg(
        F.count("*").alias("records"), F.count_distinct(person).alias("people"), F.sum(files).alias("files")
    )


def day_people(records: DataFrame, day: Column, person: Column) -> DataFrame:
    """Distinct (day, person) with record counts; rows stay rows, no list per day is collected."""
    return records.groupBy(day.alias("day"), person.alias("person")).agg(F.count("*").alias("records"))


def record_fragment(title: Column, kind: Column, text: Column) -> Column:
    """One record as an HTML article."""
    return F.concat(
        F.lit("<article><h3>"), escape_html(title), F.lit(" | "), escape_html(kind), F.lit("</h3><p>"), escape_html(text),
        F.lit("</p></article>"),
    )


def day_page(records: DataFrame, day: Column, person: Column, order: Column, fragment: Column, heading: str) -> DataFrame:
    """A day page as ordered fragments (day, person, part, order, html).

    Part 0 opens the page, part 1 opens a person's section, part 2 holds the records, part 3 closes the section and
    part 4 the page. Written sorted by (day, person, part, order) the rows are the page; no string grows with the day.
    """
    body = records.select(day.alias("day"), person.alias("person"), F.lit(2).alias("part"), order.alias("at"), fragment.alias("html"))
    people = body.select("day", "person").distinct()
    days = people.select("day").distinct()
    opened = people.select("day", "person", F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("at"),
                           F.concat(F.lit("<section><h2>"), escape_html(F.col("person")), F.lit("</h2>")).alias("html"))
    closed = people.select("day", "person", F.lit(3).alias("part"), F.lit(0).cast("bigint").alias("at"), F.lit("</section>").alias("html"))
    head = days.select("day", F.lit("").alias("person"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("at"),
                       F.concat(F.lit(f"<!DOCTYPE html><html><body><h1>{heading} "), escape_html(F.col("day").cast("string")), F.lit("</h1>")).alias("html"))
    foot = days.select("day", F.lit("\U0010ffff").alias("person"), F.lit(4).alias("part"), F.lit(0).cast("bigint").alias("at"),
                       F.lit("</body></html>").alias("html"))
    return head.unionByName(opened).unionByName(body).unionByName(closed).unionByName(foot)


def change_fragment() -> Column:
    """A change record as a section of the change log; expects the change columns."""
    return F.concat_ws(
        "\n", F.concat(F.lit("## "), F.upper("type"), F.lit(" | "), F.col("section"), F.lit(" / "), F.col("title")), F.lit(""),
        F.concat(F.lit("- HTML: `"), F.col("html"), F.lit("`")),
        F.concat(F.lit("- Previous SHA-256: `"), F.col("previous_sha256"), F.lit("`")),
        F.concat(F.lit("- Current SHA-256: `"), F.col("current_sha256"), F.lit("`")),
        F.concat(F.lit("- Detected at: "), F.col("detected_at")), F.lit(""), F.lit("```diff"),
        F.array_join("diff", "\n"), F.lit("```"), F.lit(""),
    )


def numbered_records(records: DataFrame, channel: str, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """Adds ``id``: ``<channel>-<n>``, n running within the key (the day)."""
    from lorebase.operators.grouping import numbered_within

    numbered = numbered_within(records, keys, order, block, "_n")
    return numbered.withColumn("id", F.concat(F.lit(channel + "-"), F.col("_n"))).drop("_n")


def compact_records(records: DataFrame, limit: int | None = None) -> DataFrame:
    """What a classifier is shown of each record; ``limit`` cuts the text to what its service takes."""
    text = F.coalesce("text", F.lit(""))
    return records.select("id", "time", "person", "kind", (F.substring(text, 1, limit) if limit else text).alias("text"))


def attachment_paths(records: DataFrame, path: Column, keys: Sequence[str]) -> DataFrame:
    """Distinct attachment paths per key with their first place; blank paths are left out."""
    named = records.withColumn("path", path).filter(F.coalesce("path", F.lit("")) != "")
    return named.groupBy(*keys, "path").agg(F.min("ordinal").alias("first"))


def largest_variant(files: DataFrame, keys: Sequence[str], rank: Column | None = None) -> DataFrame:
    """Of several sizes of one picture, the largest, with the largest size; ``rank`` says which is largest if not the size alone.

    Of equal ranks the larger file counts, then the earlier one.
    """
    order = F.struct(F.col("file_size") if rank is None else rank, "file_size", -F.col("file_id"))
    return files.groupBy(*keys).agg(F.max_by("file_id", order).alias("file_id"), F.max("file_size").alias("file_size"))


def handoff_problems() -> Column:
    """Fields of a hand-off payload that break its rules; expects the hand-off columns."""
    def blank(name: str) -> Column:
        return F.when(F.trim(F.coalesce(F.col(name), F.lit(""))) == "", F.lit(name))

    return F.array_compact(F.array(blank("session_id"), blank("actor"), blank("objective")))


def entry_violations(entries: DataFrame, require_confidence: bool = False) -> DataFrame:
    """Adds ``violations``: the constraints of the entry schema a row breaks."""
    def bad(name: str, condition: Column) -> Column:
        return F.when(condition, F.lit(name))

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    confidence = ~F.col("confidence").isin(*rules.ENTRY_CONFIDENCE)
    checks = [
        bad("id", ~F.coalesce(F.col("id"), F.lit("")).rlike(rules.ENTRY_ID_PATTERN)),
        bad("title", blank("title")),
        bad("type", ~F.coalesce(F.col("type"), F.lit("")).isin(*rules.ENTRY_TYPES)),
        bad("status", ~F.coalesce(F.col("status"), F.lit("")).isin(*rules.ENTRY_STATUS)),
        bad("date", ~F.coalesce(F.col("date"), F.lit("")).rlike(rules.ENTRY_DATE_PATTERN)),
        bad("source_refs", F.size(F.coalesce("source_refs", F.array().cast("array<string>"))) < 1),
        bad("confidence", F.coalesce(confidence, F.lit(require_confidence))),
        bad("summary", blank("summary")),
    ]
    return entries.withColumn("violations", F.array_compact(F.array(*checks)))


def append_once(log: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Entries whose key the log does not hold yet, each key once."""
    return entries.join(log.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def handoff_fragment(empty: str = "None recorded.") -> Column:
    """A hand-off payload as Markdown; expects the hand-off columns."""
    def section(heading: str, name: str) -> Column:
        items = F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda v: F.concat(F.lit("- "), v))
        return F.concat(F.lit(f"## {heading}\n\n"), F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise(F.lit(f"- {empty}")))

    names = (("Current State", "state"), ("Completed", "completed"), ("Decisions", "decisions"), ("Blockers", "blockers"),
             ("Next Actions", "next_actions"), ("Files To Read", "files_to_read"), ("Changed Files", "changed_files"), ("Notes", "notes"))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("objective")), F.concat(F.lit("- Session: "), F.col("session_id"), F.lit("\n- Actor: "), F.col("actor")),
                       *[section(*n) for n in names])
