"""The registry and SQL fragments shared by the twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorebase import rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL twin where SQL can say the same."""
    def keep(build):
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build
    return keep


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def strip(x: str) -> str:
    return f"trim({x}, {quoted(rules.SPACE_CHARS)})"


def compact(x: str) -> str:
    return f"trim(regexp_replace({x}, '{rules.SPACE}+', ' ', 'g'))"


def fold(x: str) -> str:
    return f"replace(replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's')"


def redact(x: str, rule_set=rules.INDEX_REDACTION) -> str:
    for pattern, replacement in rule_set:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(replacement.replace('$1', chr(92) + '1'))}, 'g')"
    return x


def any_of(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(n)})" for n in needles) + ")"


def matches(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {quoted(p)})" for p in patterns) + ")"


def count_of(x: str, term: str) -> str:
    """Non-overlapping occurrences, capped like the score does."""
    return f"((length({x}) - length(replace({x}, {quoted(term)}, ''))) // {len(term)})"


SOURCES = f"""
    SELECT doc_id AS ordinal, 'doc:' || doc_id AS source_id, source AS source_type, lang AS section,
           {compact(f"substr({redact('text')}, 1, 80)")} AS title, {redact('text')} AS text FROM documents
"""

# One paragraph per document: windows of 1800 characters that step by 1580.
CHUNKS = f"""
    src AS ({SOURCES}),
    cut AS (
        SELECT source_id, 1 AS n, {strip('text')} AS rest, NULL::VARCHAR AS piece FROM src
        UNION ALL
        SELECT source_id, n + 1, {strip('substr(rest, 1581)')}, {strip('substr(rest, 1, 1800)')} FROM cut
        WHERE length(rest) > 1800
    ),
    pieces AS (
        SELECT source_id, n - 1 AS chunk_index, piece FROM cut WHERE piece IS NOT NULL
        UNION ALL SELECT source_id, n, rest FROM cut WHERE length(rest) <= 1800 AND rest <> ''
    ),
    clean AS (SELECT source_id, chunk_index, {redact('piece')} AS text FROM pieces),
    chunks AS (
        SELECT src.ordinal, src.source_id, src.source_type, src.section, src.title, clean.chunk_index, clean.text,
               sha256(clean.text) AS text_hash,
               'chunk-' || substr(sha256(src.source_id || ':' || clean.chunk_index || ':' || sha256(clean.text)), 1, 20) AS chunk_id
        FROM clean JOIN src USING (source_id) WHERE length({compact('clean.text')}) >= 30
    )
"""


def lexical(question: str, terms: list[str]) -> str:
    """Lexical score over hay, title_cf and section_cf for Latin terms without aliases."""
    parts = [f"(CASE WHEN contains(hay, {quoted(question.lower())}) THEN 12.0 ELSE 0 END)::DOUBLE"]
    for term in terms:
        weight = 1.6 if len(term) <= 3 else 2.2
        parts.append(f"{weight}::DOUBLE * least(4, {count_of('hay', term)})")
        parts.append(f"(CASE WHEN contains(title_cf, {quoted(term)}) THEN 4.0 ELSE 0 END)::DOUBLE")
        parts.append(f"(CASE WHEN contains(section_cf, {quoted(term)}) THEN 2.0 ELSE 0 END)::DOUBLE")
    return " + ".join(parts)


FOLDED = f"""
    folded AS (
        SELECT *, {fold("section || chr(10) || title || chr(10) || source_type || chr(10) || chr(10) || chr(10) || text || chr(10) || 'kind: ' || source_type")} AS hay,
               {fold('title')} AS title_cf, {fold('section')} AS section_cf FROM chunks
    )
"""
