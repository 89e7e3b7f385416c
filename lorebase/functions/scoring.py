"""Scores as plain arithmetic over Columns. Terms are literals, so every score is one generated expression."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lorebase import rules
from lorebase.functions.terms import term_weight
from lorebase.functions.text import casefold, compact


def total(parts: Sequence[Column]) -> Column:
    return reduce(add, parts, F.lit(0.0))


def bonus(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal term."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))
    return F.when(F.contains(text, F.lit(term)), (removed / len(term)).cast("int")).otherwise(F.lit(0))


def chunk_haystack() -> Column:
    """Case-folded text a chunk is searched in; expects the chunk columns."""
    from lorebase.functions.text import flatten_map

    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("section", "title", "source_type", "date", "author", "text")]
    return casefold(F.concat_ws("\n", *fields, F.coalesce(flatten_map(F.col("metadata")), F.lit(""))))


def chunk_lexical(
    hay: Column, title: Column, section: Column, question: str, terms: Sequence[str], alias_texts: Sequence[str]
) -> Column:
    """Phrase and alias bonuses plus weighted, capped term counts; ``title`` and ``section`` are case-folded."""
    phrase = question.casefold().strip()
    parts = [bonus(F.contains(hay, F.lit(a.casefold())), rules.ALIAS_BONUS) for a in alias_texts]
    if len(phrase) >= 3:
        parts.append(bonus(F.contains(hay, F.lit(phrase)), rules.PHRASE_BONUS))
    for term in terms:
        counted = F.least(F.lit(rules.TERM_COUNT_CAP), occurrences(hay, term)) * F.lit(term_weight(term))
        # title and section are part of the haystack, so a hit there is always a hit in the count as well
        parts += [
            counted,
            bonus(F.contains(title, F.lit(term)), rules.TITLE_BONUS),
            bonus(F.contains(section, F.lit(term)), rules.SECTION_BONUS),
        ]
    return total(parts)


def saturate(lexical: Column) -> Column:
    return F.when(lexical > 0, lexical / (lexical + rules.LEXICAL_HALF_POINT)).otherwise(F.lit(0.0))


def blend(semantic: Column, lexical: Column) -> Column:
    return (
        F.greatest(F.lit(0.0), semantic) * rules.SEMANTIC_SHARE + saturate(lexical) * rules.LEXICAL_SHARE
    )


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine with a fixed query vector; 0 for null, another length, or a zero norm.

    A fold over array elements is interpreted, about a microsecond per dimension; one matrix product per Arrow batch
    took a quarter of the time for 64 dimensions, and only the vectors travel.
    """
    target = np.asarray(query, dtype="float64")
    norm = float(np.linalg.norm(target))
    if norm == 0.0:
        return F.lit(0.0)

    def similarities(vectors: pd.Series) -> pd.Series:
        result = np.zeros(len(vectors))
        fits = np.array([v is not None and len(v) == len(target) for v in vectors], dtype=bool)
        if fits.any():
            rows = np.stack(vectors[fits].to_numpy()).astype("float64")
            sizes = np.linalg.norm(rows, axis=1) * norm
            result[fits] = np.divide(rows @ target, sizes, out=np.zeros(len(rows)), where=sizes > 0)
        return pd.Series(result)

    similarities.__annotations__ = {"vectors": pd.Series, "return": pd.Series}
    return F.pandas_udf(similarities, DoubleType())(vector)


def page_score(fields: Mapping[str, Column], question: str, terms: Sequence[str],
               weights: Mapping[str, float] = rules.PAGE_FIELD_WEIGHTS) -> Column:
    """Field weights, once per term and field, plus the phrase bonus; fields are case-folded."""
    phrase = question.casefold().strip()
    parts = []
    if phrase:
        hay = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in fields.values()])
        parts.append(bonus(F.contains(hay, F.lit(phrase)), rules.PHRASE_BONUS))
    for name, column in fields.items():
        parts += [bonus(F.contains(column, F.lit(term)), weights[name]) for term in terms]
    return total(parts)


def memory_score(hay: Column, tags: Column, title: Column, tokens: Sequence[str]) -> Column:
    parts = []
    for token in tokens:
        parts += [
            occurrences(hay, token).cast("long"),
            F.when(F.contains(tags, F.lit(token)), F.lit(rules.MEMORY_TAG_BONUS)).otherwise(F.lit(0)),
            F.when(F.contains(title, F.lit(token)), F.lit(rules.MEMORY_TITLE_BONUS)).otherwise(F.lit(0)),
        ]
    return reduce(add, parts, F.lit(0).cast("long"))


def file_score(hay: Column, path_suffix: Column, request: str, terms: Sequence[str]) -> Column:
    score = reduce(add, [F.contains(hay, F.lit(t)).cast("int") for t in terms], F.lit(0))
    if re.search("说明书|manual|pdf", request.casefold()):
        score = score + F.when(path_suffix == ".pdf", F.lit(2)).otherwise(F.lit(0))
    return score


def first_hit(folded: Column, terms: Sequence[str]) -> Column:
    """1-based position of the earliest term, null without a hit."""
    positions = [F.nullif(F.instr(folded, term), F.lit(0)) for term in dict.fromkeys(terms)]
    if not positions:
        return F.lit(None).cast("int")
    return positions[0] if len(positions) == 1 else F.least(*positions)


def snippet(text: Column, terms: Sequence[str], length: int = rules.CHUNK_SNIPPET) -> Column:
    """``length`` characters that start a third before the earliest hit, or the beginning without a hit."""
    flat = compact(text)
    start = F.greatest(F.lit(0), F.coalesce(first_hit(casefold(flat), terms), F.lit(1)) - 1 - length // 3)
    return F.substring(flat, start + 1, F.lit(length))


def memory_snippet(text: Column, length: int = rules.MEMORY_SNIPPET) -> Column:
    flat = compact(text)
    cut = F.concat(F.rtrim(F.substring(flat, 1, length - 3)), F.lit("..."))
    return F.when(F.length(flat) <= length, flat).otherwise(cut)


def likely_band(top_score: Column) -> Column:
    return F.when(top_score >= rules.HIGH_BAND, "yes").when(top_score >= rules.MEDIUM_BAND, "likely").otherwise("unknown")


def confidence_band(top_score: Column) -> Column:
    return F.when(top_score >= rules.HIGH_BAND, "high").when(top_score >= rules.MEDIUM_BAND, "medium").otherwise("low")


def clear_evidence(evidence_count: Column, likely: Column, confidence: Column, top_score: Column) -> Column:
    return (evidence_count > 0) & (likely != "unknown") & (confidence != "low") & (
        F.coalesce(top_score, F.lit(0.0)) >= rules.MEDIUM_BAND
    )
