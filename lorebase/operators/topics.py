"""Topic groups: every record ends up in a valid section."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions.text import slug_topic, strip
from lorebase.operators.grouping import last_per_key, top_per_key


def cover_records(
    groups: DataFrame, records: DataFrame, sections: DataFrame, source: str, day: str,
    channel_sections: Sequence[str] = rules.CHANNEL_SECTIONS,
) -> DataFrame:
    """(record_id, section, topic_title, origin) after normalisation.

    ``groups``: record_id, section, topic_title, one row per claimed member. Members that are no record of the
    day are dropped, unknown sections become the unsorted one, and records nobody claimed go to an unsorted
    group of their own. ``sections``: section (the ones that exist). All joins are semi or anti joins on ids.
    """
    unsorted = F.lit(rules.UNSORTED_SECTION)
    valid = sections.filter(~F.col("section").isin(*channel_sections) & (F.col("section") != "")).select("section").distinct()
    claimed = groups.withColumn("section", strip(F.coalesce("section", unsorted)))
    members = claimed.join(records.select("record_id"), "record_id", "left_semi").join(
        valid.withColumn("_ok", F.lit(True)), "section", "left"
    )
    default_title = F.lit(f"{source} supplement")
    placed = members.select(
        "record_id", F.when(F.col("_ok"), F.col("section")).otherwise(unsorted).alias("section"),
        F.coalesce(F.nullif(strip(F.col("topic_title")), F.lit("")), default_title).alias("topic_title"),
        F.lit("group").alias("origin"),
    )
    missing = records.select("record_id").join(members.select("record_id"), "record_id", "left_anti").select(
        "record_id", unsorted.alias("section"), F.lit(f"{source.title()} supplement {day}").alias("topic_title"),
        F.lit("fallback").alias("origin"),
    )
    return placed.unionByName(missing)


LISTS = ("what_happened", "important_facts", "decisions_or_conclusions", "open_questions_or_next_steps", "people_organizations_equipment", "tags",
         "confidence_notes", "important_assets_or_attachments")


def with_defaults(distilled: Column, source: str, day: str, attachments: Sequence[str] = ()) -> Column:
    """A group's distillation with every field there: what a model left out is filled in, and tags and notes say where it is from."""
    def many(name: str) -> Column:
        empty = F.array(*[F.lit(a) for a in attachments[:40]]) if name == "important_assets_or_attachments" and attachments else F.array()
        return F.coalesce(distilled[name], empty.cast("array<string>"))

    def appended(values: Column, extra: Sequence[str]) -> Column:
        for text in extra:
            values = F.when(F.array_contains(values, text), values).otherwise(F.array_append(values, F.lit(text)))
        return values

    added = {"tags": (source, "communication-supplement", day), "confidence_notes": (f"Supplement distilled from {source} records archived on {day}.",)}
    summary = F.coalesce(distilled["one_sentence_summary"], F.lit(f"{day} {source} supplemental records."))
    return F.struct(summary.alias("one_sentence_summary"), *[appended(many(name), added.get(name, ())).alias(name) for name in LISTS])


def normalised_groups(groups: DataFrame, members: DataFrame, records: DataFrame, sections: DataFrame, source: str, day: str,
                      attachments: Sequence[str] = (), channel_sections: Sequence[str] = rules.CHANNEL_SECTIONS) -> tuple[DataFrame, DataFrame]:
    """What a classifier proposed, made fit for the notebook: ``(group_id, section, topic_title, distilled)`` and ``(group_id, record_id)``.

    ``groups``: group_id, section, topic_title, distilled (may be null); ``members``: group_id, record_id; ``records``: record_id,
    ordinal, label, text. Groups without a record of the day go, unknown sections become the unsorted one, and records that no
    group holds make a group of their own, with the first of them as its facts.
    """
    valid = sections.filter(~F.col("section").isin(*channel_sections) & (F.col("section") != "")).select("section").distinct().withColumn("_ok", F.lit(True))
    held = members.select("group_id", "record_id").distinct().join(records.select("record_id"), "record_id", "left_semi").select("group_id", "record_id")
    unsorted, default_title = F.lit(rules.UNSORTED_SECTION), F.lit(f"{source} supplement")
    named = groups.join(held, "group_id", "left_semi").withColumn("section", strip(F.coalesce(F.nullif("section", F.lit("")), unsorted))).join(valid, "section", "left")
    filled = named.select("group_id", F.when(F.col("_ok"), F.col("section")).otherwise(unsorted).alias("section"),
                          F.coalesce(F.nullif(strip(F.col("topic_title")), F.lit("")), default_title).alias("topic_title"),
                          with_defaults(F.col("distilled"), source, day, attachments).alias("distilled"))
    missing = records.join(held.select("record_id"), "record_id", "left_anti")
    alone = F.lit("unclaimed")
    rest = fallback_facts(missing, "ordinal").groupBy(alone.alias("group_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "fact"))), lambda f: f["fact"]).alias("facts"))
    empty = F.lit(None).cast("array<string>")
    bare = F.struct(F.lit(None).cast("string").alias("one_sentence_summary"), *[(F.col("facts") if n == "important_facts" else empty).alias(n) for n in LISTS])
    rest = rest.select("group_id", unsorted.alias("section"), F.lit(f"{source.title()} supplement {day}").alias("topic_title"), with_defaults(bare, source, day, attachments).alias("distilled"))
    return filled.unionByName(rest), held.unionByName(missing.select(alone.alias("group_id"), "record_id"))


def content_pages(groups: DataFrame, members: DataFrame, source: str, day: str, html: str, now: str) -> DataFrame:
    """The supplement pages of a day's groups, in the shape of distilled pages, with the number of records behind each.

    Of groups with one section and title the last one's page stays. Which records a page is from is in the members' table.
    """
    counts = members.groupBy("group_id").agg(F.count("*").alias("records"))
    pages = groups.join(counts, "group_id").select(
        "group_id", "section", supplement_title(F.col("topic_title"), source, day).alias("title"), F.lit(html).alias("html"), F.lit("").alias("source_sha256"),
        F.lit(now).alias("created"), F.lit(now).alias("updated"), F.lit(source).alias("source_channel"), "records", "distilled")
    return last_per_key(pages, ["section", "title"], ["group_id"])


def ensure_sections(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sections`` (section, page_count) and an empty one for each wanted name that is not among them."""
    new = wanted.select("section").where("section IS NOT NULL").distinct().join(sections.select("section"), "section", "left_anti")
    return sections.select("section", "page_count", F.lit(False).alias("created")).unionByName(new.select("section", F.lit(0).cast(sections.schema["page_count"].dataType).alias("page_count"), F.lit(True).alias("created")))


def prune_empty_sections(sections: DataFrame, pages: DataFrame, channel_sections: Sequence[str] = rules.CHANNEL_SECTIONS) -> DataFrame:
    """Sections without the channels' own ones that have no page left."""
    empty = sections.filter(F.col("section").isin(*channel_sections)).join(pages.select("section").distinct(), "section", "left_anti").select("section")
    return sections.join(empty, "section", "left_anti")


def supplement_title(topic: F.Column, source: str, day: str) -> F.Column:
    return F.concat(slug_topic(topic, "communication supplement"), F.lit(f" Supplement {day} [{source}]"))


def supplement_pages(covered: DataFrame, source: str, day: str) -> DataFrame:
    """One supplement page per (section, topic) with the number of records behind it."""
    return covered.groupBy("section", supplement_title(F.col("topic_title"), source, day).alias("title")).agg(
        F.count("*").alias("records"), F.min("record_id").alias("first_record")
    )


def fallback_facts(records: DataFrame, order: str, limit: int = 30, chars: int = 500) -> DataFrame:
    """``label: preview`` of the first records of the day, the body of the fallback group."""
    first = records.orderBy(order).limit(limit)
    return first.select(order, F.concat(F.col("label"), F.lit(": "), F.substring("text", 1, chars)).alias("fact"))


def section_directory(pages: DataFrame, order: str, limit: int = 25) -> DataFrame:
    """The first pages of each topic section, as shown to a classifier; channel sections are left out."""
    hidden = [*rules.CHANNEL_SECTIONS, rules.UNSORTED_SECTION, ""]
    return top_per_key(pages.filter(~F.col("section").isin(*hidden)), ["section"], [F.asc(order)], limit)


def drop_channel_page(pages: DataFrame, channel_section: str, day: str) -> DataFrame:
    """Pages without the one the channel wrote for that day."""
    return pages.filter(~((F.col("section") == channel_section) & (F.col("title") == f"{channel_section} {day}")))
