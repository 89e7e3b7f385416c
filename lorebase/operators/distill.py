"""Page distillation and its roll-ups per section and notebook."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions import distill as D
from lorebase.operators.grouping import top_per_key
from lorebase.session import persist_table


def distill_pages(pages: DataFrame, keywords: Sequence[tuple[str, str]] = rules.KEYWORD_TAGS,
                  outcome_words: Sequence[str] = rules.OUTCOME_WORDS,
                  step_words: Sequence[str] = rules.NEXT_STEP_WORDS) -> DataFrame:
    """``pages``: ordinal, section, title, text (and more). Row-wise; sentences are split once."""
    with_sentences = pages.withColumn("_sentences", D.sentences(F.col("text")))
    tag_text = F.concat_ws("\n", F.col("section"), F.col("title"), F.col("text"))
    return with_sentences.select(
        *pages.columns,
        D.summary(F.col("text"), F.col("_sentences"), F.col("title")).alias("summary"),
        D.keyword_tags(tag_text, keywords).alias("tags"),
        D.important_facts(F.col("_sentences"), outcome_words).alias("important_facts"),
        D.next_steps(F.col("_sentences"), step_words).alias("next_steps_or_questions"),
        F.length("text").alias("text_characters"),
    )


def section_tags(distilled: DataFrame, limit: int = rules.SECTION_TAGS) -> DataFrame:
    """Most frequent tags per section; equal counts by first appearance (page, then position)."""
    exploded = distilled.select("section", "ordinal", F.posexplode("tags").alias("position", "tag"))
    counted = exploded.groupBy("section", "tag").agg(
        F.count("*").alias("pages"), F.min(F.struct("ordinal", "position")).alias("first")
    )
    ranked = top_per_key(counted, ["section"], [F.desc("pages"), F.asc("first")], limit)
    return ranked.select("section", "tag", "pages", "rank")


def section_facts(distilled: DataFrame, limit: int = rules.SECTION_FACTS,
                  per_page: int = rules.SECTION_FACTS_PER_PAGE) -> DataFrame:
    """First facts per section: at most two from each page, in page order."""
    exploded = distilled.select(
        "section", "ordinal", F.posexplode(F.slice("important_facts", 1, per_page)).alias("position", "fact")
    )
    return top_per_key(exploded, ["section"], [F.asc("ordinal"), F.asc("position")], limit)


def section_rollup(distilled: DataFrame) -> DataFrame:
    """One row per section: page count, top tags, highlight facts, summary sentence.

    The distillation is written once, as three aggregates read it. Pages are counted, and tags and facts cut to
    their dozen, before anything is collected per section.
    """
    distilled = persist_table(distilled.select(
        "section", "ordinal", "tags", F.slice("important_facts", 1, rules.SECTION_FACTS_PER_PAGE).alias("important_facts")
    ), "distilled")
    pages = distilled.groupBy("section").agg(F.count("*").alias("page_count"))
    tags = section_tags(distilled).groupBy("section").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda e: e["tag"]).alias("top_tags")
    )
    facts = section_facts(distilled).groupBy("section").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "fact"))), lambda e: e["fact"]).alias("highlight_facts")
    )
    none = F.array().cast("array<string>")
    joined = pages.join(tags, "section", "left").join(facts, "section", "left")
    named = F.array_join(F.slice(F.coalesce("top_tags", none), 1, rules.SECTION_SUMMARY_TAGS), ", ")
    return joined.select(
        "section", "page_count",
        F.concat(F.col("section"), F.lit(" contains "), F.col("page_count"), F.lit(" pages. Main tags: "),
                 F.when(named == "", "none detected").otherwise(named), F.lit(".")).alias("summary"),
        F.coalesce("top_tags", none).alias("top_tags"), F.coalesce("highlight_facts", none).alias("highlight_facts"),
    )


def _merged_best(items: DataFrame, levels: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` items of each notebook, from the first ``limit`` of each section below it: a section hands on its
    best only, in page order, and the notebook takes them in turn, the first of every section before any second one."""
    best = top_per_key(items, list(levels), [F.asc("ordinal"), F.asc("position")], limit, "place")
    return top_per_key(best, [levels[0]], [F.asc("place"), F.asc("ordinal"), F.asc("position")], limit)


def notebook_rollup(distilled: DataFrame, notebook: str = "notebook", limit: int = rules.SECTION_FACTS) -> DataFrame:
    """One row per notebook over all its sections: pages, topics, highlight facts, open questions, a summary sentence.

    Every level is a merge of bounded or counted rows of the level below: tags are counted per section and then summed up,
    facts and questions cut to the best of a section and then of the notebook. What is collected per notebook is a dozen rows.
    """
    per_page = rules.SECTION_FACTS_PER_PAGE
    pages = persist_table(distilled.select(notebook, "section", "ordinal", "tags", F.slice("important_facts", 1, per_page).alias("facts"),
                                           F.slice("next_steps_or_questions", 1, per_page).alias("steps")), "notebook-pages")
    sections = pages.groupBy(notebook, "section").agg(F.count("*").alias("pages"))
    counts = sections.groupBy(notebook).agg(F.sum("pages").alias("page_count"), F.count("*").alias("section_count"))
    tagged = pages.select(notebook, "section", "ordinal", F.posexplode("tags").alias("position", "tag")).groupBy(notebook, "section", "tag").agg(
        F.count("*").alias("pages"), F.min(F.struct("ordinal", "position")).alias("first"))
    topics = top_per_key(tagged.groupBy(notebook, "tag").agg(F.sum("pages").alias("pages"), F.min("first").alias("first")), [notebook],
                         [F.desc("pages"), F.asc("first")], rules.SECTION_TAGS)
    out = counts
    for name, rows, value in (("top_topics", topics, "tag"),
                              *((name, _merged_best(pages.select(notebook, "section", "ordinal", F.posexplode(source).alias("position", "item")), (notebook, "section"), limit), "item")
                                for name, source in (("highlight_facts", "facts"), ("open_questions", "steps")))):
        listed = rows.groupBy(notebook).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda e: e[value]).alias(name))
        out = out.join(listed, notebook, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    named = F.array_join(F.slice("top_topics", 1, rules.SECTION_SUMMARY_TAGS), ", ")
    summary = F.concat(F.col(notebook), F.lit(" contains "), F.col("page_count"), F.lit(" pages in "), F.col("section_count"), F.lit(" sections. Main topics: "),
                       F.when(named == "", "none detected").otherwise(named), F.lit("."))
    return out.select(notebook, "section_count", "page_count", summary.alias("summary"), "top_topics", "highlight_facts", "open_questions")


def page_counts(pages: DataFrame) -> DataFrame:
    """Pages per section and in total (section null) in one pass."""
    return pages.rollup("section").agg(F.count("*").alias("page_count"))
