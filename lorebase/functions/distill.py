"""Local distillation: sentences, facts, next steps, tags and a summary per text, all array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions.text import casefold, compact, contains_any, strip


def sentences(text: Column) -> Column:
    """Split after sentence punctuation plus white space and at line breaks; pieces over 8 characters."""
    raw = F.split(text, rf"(?!{rules.PRINTABLE})(?:(?<=[。！？.!?]){rules.SPACE}+|\n+)")
    return F.transform(F.filter(raw, lambda s: F.length(strip(s)) > rules.MIN_SENTENCE), compact)


def fact_points(sentence: Column, outcome_words: Sequence[str] = rules.OUTCOME_WORDS) -> Column:
    length = F.length(sentence)
    return (
        F.when(sentence.rlike("[0-9]") & sentence.rlike(rules.FACT_PATTERN), 3).otherwise(0)
        + F.when(contains_any(casefold(sentence), outcome_words), 2).otherwise(0)
        + F.when(length.between(rules.FACT_MIN_CHARS, rules.FACT_MAX_CHARS), 1).otherwise(0)
    )


def important_facts(sentence_list: Column, outcome_words: Sequence[str] = rules.OUTCOME_WORDS,
                    limit: int = rules.MAX_FACTS) -> Column:
    """Best sentences: most points first, then the shortest, then the earliest."""
    scored = F.transform(
        sentence_list,
        lambda s, i: F.struct((-fact_points(s, outcome_words)).alias("rank"), F.length(s).alias("size"), i.alias("at"), s.alias("text")),
    )
    kept = F.array_sort(F.filter(scored, lambda e: e["rank"] < 0))
    return F.transform(F.slice(kept, 1, limit), lambda e: e["text"])


def next_steps(sentence_list: Column, words: Sequence[str] = rules.NEXT_STEP_WORDS, limit: int = rules.MAX_STEPS) -> Column:
    return F.slice(F.filter(sentence_list, lambda s: contains_any(casefold(s), words)), 1, limit)


def keyword_tags(text: Column, keywords: Sequence[tuple[str, str]] = rules.KEYWORD_TAGS,
                 limit: int = rules.MAX_TAGS) -> Column:
    """Labels of the keywords that occur, in dictionary order."""
    labels = F.transform(F.array(casefold(text)), lambda low: F.array_compact(F.array(*[
        F.when(F.contains(low, F.lit(key.casefold())), F.lit(label)) for key, label in keywords
    ])))
    return F.slice(F.array_distinct(F.element_at(labels, 1)), 1, limit)


def summary(text: Column, sentence_list: Column, title: Column) -> Column:
    preview = F.substring(compact(text), 1, rules.SUMMARY_CHARS)
    fallback = F.concat(F.lit("No readable text extracted for "), title, F.lit("."))
    return F.when(F.size(sentence_list) > 0, F.substring(F.get(sentence_list, F.lit(0)), 1, rules.SUMMARY_CHARS)).when(
        preview != "", preview).otherwise(fallback)
