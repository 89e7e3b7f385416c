"""Rankers. Each is one scan with a native score and a top-k: no shuffle but that of the k best rows per task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions import scoring as S
from lorebase.functions import terms as Q
from lorebase.functions.text import base_name, casefold, flatten_list, suffix
from lorebase.operators.grouping import top_per_key


def with_search_text(chunks: DataFrame) -> DataFrame:
    """Chunks with the folded texts they are searched in; an index that stores these is left as it is."""
    if "hay" in chunks.columns:
        return chunks
    return chunks.select(
        "*", S.chunk_haystack().alias("hay"), casefold(F.col("title")).alias("title_cf"),
        casefold(F.col("section")).alias("section_cf"),
    )


def _lexical(question: str, alias_rules: Q.AliasRules) -> Column:
    return S.chunk_lexical(
        F.col("hay"), F.col("title_cf"), F.col("section_cf"), question,
        Q.question_terms(question, alias_rules), Q.aliases(question, alias_rules),
    )


def _best_first() -> list[Column]:
    """Score, lexical score, then the date as a string; ties keep index order."""
    return [F.desc(c) for c in ("score", "lexical_score", "date")] + [F.asc("ordinal"), F.asc("chunk_index")]


def rank_chunks(
    chunks: DataFrame,
    question: str,
    query_vector: Sequence[float] | None = None,
    top_k: int = rules.CANDIDATES,
    alias_rules: Q.AliasRules = rules.CHUNK_ALIASES,
) -> DataFrame:
    """The ``top_k`` chunks for a question, lexical only or blended with the cosine of their vectors.

    Rows without any score are dropped after the limit: they sort last, so the result is the same, and the
    filter does not make Spark evaluate the score twice.
    """
    folded = with_search_text(chunks).withColumn("_lex", _lexical(question, alias_rules))
    if query_vector is None:
        scored = folded.withColumn("_sem", F.lit(0.0)).withColumn("_final", S.saturate(F.col("_lex")))
    else:
        semantic = S.cosine(F.col("vector"), query_vector)
        scored = folded.withColumn("_sem", F.coalesce(semantic, F.lit(0.0))).withColumn(
            "_final", S.blend(F.col("_sem"), F.col("_lex"))
        )
    rounded = scored.select(
        *chunks.columns, F.round("_lex", 4).alias("lexical_score"), F.round("_sem", 6).alias("semantic_score"),
        F.round("_final", 6).alias("score"),
    )
    return rounded.orderBy(*_best_first()).limit(top_k).filter((F.col("score") > 0) | (F.col("lexical_score") > 0))


def with_snippet(candidates: DataFrame, question: str, length: int = rules.CHUNK_SNIPPET,
                 alias_rules: Q.AliasRules = rules.CHUNK_ALIASES) -> DataFrame:
    terms = Q.question_terms(question, alias_rules)
    return candidates.withColumn("snippet", S.snippet(F.col("text"), terms, length))


def rank_question_set(
    chunks: DataFrame, questions: Sequence[str], top_k: int = rules.CANDIDATES_MIN,
    alias_rules: Q.AliasRules = rules.CHUNK_ALIASES,
) -> DataFrame:
    """Lexical ranking of a fixed set of questions in one scan (a retrieval regression run).

    Each chunk row is scored against every question in place; only scored rows are unfolded, and the limit per
    question is applied before the shuffle.
    """
    scores = F.array(*[
        F.struct(F.lit(n).alias("question_no"), _lexical(q, alias_rules).alias("lex"))
        for n, q in enumerate(questions, start=1)
    ])
    hits = with_search_text(chunks).select(*chunks.columns, F.explode(F.filter(scores, lambda s: s["lex"] > 0)).alias("hit"))
    scored = hits.select(
        "hit.question_no", *chunks.columns, F.round("hit.lex", 4).alias("lexical_score"),
        F.round(S.saturate(F.col("hit.lex")), 6).alias("score"),
    )
    return top_per_key(scored, ["question_no"], _best_first(), top_k)


def nearest(vectors: DataFrame, query_vector: Sequence[float], key: str, vector: str, top_k: int) -> DataFrame:
    """The ``top_k`` rows by cosine, ties by key. Brute force, as a ranking over all vectors has to be exact."""
    scored = vectors.withColumn("similarity", F.round(S.cosine(F.col(vector), query_vector), 6))
    return scored.orderBy(F.desc("similarity"), F.asc(key)).limit(top_k)


def route_by_neighbours(vectors: DataFrame, query_vector: Sequence[float], key: str, vector: str, section: str,
                        k: int) -> DataFrame:
    """Sections of the ``k`` nearest vectors with their votes: the offline stand-in for topic classification."""
    return (
        nearest(vectors, query_vector, key, vector, k)
        .groupBy(section)
        .agg(F.count("*").alias("votes"), F.round(F.max("similarity"), 4).alias("best"))
    )


def page_fields(pages: DataFrame) -> dict[str, Column]:
    """The ten searchable fields of distilled pages, case-folded."""
    plain = {"title": F.col("title"), "section": F.col("section"), "summary": F.col("distilled.one_sentence_summary")}
    lists = {
        name: F.col(f"distilled.{name}") for name in rules.PAGE_FIELD_WEIGHTS
        if name not in ("title", "section", "summary", "attachments")
    }
    lists["attachments"] = F.col("attachments")
    plain.update({name: flatten_list(column) for name, column in lists.items()})
    return {name: casefold(F.coalesce(plain[name], F.lit(""))) for name in rules.PAGE_FIELD_WEIGHTS}


def rank_pages(pages: DataFrame, question: str, order: str, fields: Mapping[str, Column] | None = None,
               top_k: int = rules.PAGE_TOP_K, alias_rules: Q.AliasRules = ()) -> DataFrame:
    """Weighted field search over pages; ``order`` keeps ties in page order. The texts of aliases add terms to the question's."""
    fields = fields or page_fields(pages)
    folded = pages.select("*", *[column.alias(f"_{name}") for name, column in fields.items()])
    score = S.page_score({n: F.col(f"_{n}") for n in fields}, question, Q.page_question_terms(question, alias_rules))
    scored = folded.withColumn("score", F.round(score, 4)).drop(*[f"_{n}" for n in fields])
    return scored.orderBy(F.desc("score"), F.asc(order)).limit(top_k).filter(F.col("score") > 0)


def with_page_snippet(hits: DataFrame, text: Column, question: str, length: int = rules.PAGE_SNIPPET, alias_rules: Q.AliasRules = ()) -> DataFrame:
    """Adds the piece of each page's text around its first hit."""
    return hits.withColumn("snippet", S.snippet(text, Q.page_question_terms(question, alias_rules), length))


def answer_bands(hits: DataFrame) -> DataFrame:
    """likely / confidence / top score / evidence count of a ranked page list (at most k rows)."""
    top = F.coalesce(F.max("score"), F.lit(0.0))
    summary = hits.agg(top.alias("top_score"), F.count("*").alias("evidence_count"))
    return summary.withColumns({
        "likely_done_before": S.likely_band(F.col("top_score")), "confidence": S.confidence_band(F.col("top_score")),
    })


def rank_memory(entries: DataFrame, query: str, top_k: int = rules.MEMORY_TOP_K) -> DataFrame:
    """Memory search over entries: term counts plus tag and title bonuses, ties in path order."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    def words(name: str) -> Column:
        return F.coalesce(F.array_join(name, " "), F.lit(""))

    fields = [text("id"), text("title"), text("type"), text("status"), text("date"), words("projects"),
              words("people"), words("tags"), text("summary"), text("body_text")]
    tags = F.concat(F.lit("["), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
    folded = entries.select(
        "*", F.lower(F.concat_ws("\n", *fields)).alias("_hay"), F.lower(tags).alias("_tags"),
        F.lower(text("title")).alias("_title"),
    )
    points = S.memory_score(F.col("_hay"), F.col("_tags"), F.col("_title"), Q.word_tokens(query))
    scored = folded.withColumn("points", points).drop("_hay", "_tags", "_title")
    best = scored.orderBy(F.desc("points"), F.asc("path")).limit(top_k).filter(F.col("points") > 0)
    preview = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.col("summary")).otherwise(F.col("body_text"))
    return best.withColumn("snippet", S.memory_snippet(preview))


def file_index(records: DataFrame) -> DataFrame:
    """One row per archived file of chat records with the text it can be found by."""
    item = records.select("created_at", F.col("text").alias("context"), F.explode("files").alias("file"))
    hay = F.concat_ws("\n", *[F.coalesce(F.col(f"file.{c}"), F.lit("")) for c in
                              ("file_name", "path", "mime_type", "classification", "text_preview")],
                      F.coalesce(F.col("context"), F.lit("")))
    return item.filter(F.coalesce(F.col("file.path"), F.lit("")) != "").select(
        F.col("file.path").alias("path"),
        F.coalesce(F.nullif(F.col("file.file_name"), F.lit("")), base_name(F.col("file.path"))).alias("file_name"),
        F.col("file.mime_type").alias("mime_type"), "created_at", "context", casefold(hay).alias("haystack"),
    )


def rank_files(files: DataFrame, request: str, top_k: int = rules.FILE_TOP_K) -> DataFrame:
    """Files whose haystack holds most of the request's terms; PDFs first when one is asked for."""
    score = S.file_score(F.col("haystack"), suffix(F.col("path")), request, Q.file_terms(request))
    scored = files.withColumn("score", score)
    ordered = scored.orderBy(F.desc("score"), F.desc("created_at"), F.asc("path"))
    return ordered.limit(top_k).filter(F.col("score") > 0)


def evidence(candidates: DataFrame) -> DataFrame:
    """Evidence records of selected candidates: distilled fields where the chunk's page has them, else its own text."""
    from lorebase.functions.text import compact, redact

    flat = compact(redact(F.col("text")))
    of = lambda name: F.try_element_at("metadata", F.lit(name))
    distilled, none = of("one_sentence_summary").isNotNull(), F.array().cast("array<string>")

    def items(name: str) -> Column:
        return F.filter(F.split(redact(F.coalesce(of(name), F.lit(""))), "\n"), lambda line: line != "")

    def listed(name: str, otherwise: Column = none) -> Column:
        return F.when(distilled, items(name)).otherwise(otherwise).alias(name)

    own_facts = F.array(F.substring(flat, 1, 1200))
    return candidates.select(
        F.col("chunk_id").alias("id"), "score", "semantic_score", "lexical_score", "source_type", "section", "title",
        F.col("path").alias("html"), F.coalesce(of("source_sha256"), F.lit("")).alias("source_sha256"),
        F.when(distilled, redact(of("one_sentence_summary"))).otherwise(F.substring(flat, 1, rules.MANIFEST_PREVIEW)).alias("summary"),
        listed("what_happened"), F.when(F.size(items("important_facts")) > 0, items("important_facts")).otherwise(own_facts).alias("important_facts"),
        listed("decisions_or_conclusions"), listed("open_questions_or_next_steps"), listed("people_organizations_equipment"),
        listed("tags", F.array("source_type")), items("attachments").alias("attachments"),
        F.substring(flat, 1, 1400).alias("source_snippet"), "date", "author",
    )


def page_evidence(pages: DataFrame, selected: DataFrame, order: Sequence[str]) -> DataFrame:
    """Evidence of the pages that a model picked from the numbered directory (1, 2, 3 ... along ``order``).

    ``selected``: position, id as text. Ids that are no number or no page are left out and a repeated one counts once, at its
    first position. The score only keeps the directory's order: 100 less the id.
    """
    from lorebase.operators.grouping import numbered_by_range

    wanted = selected.select("position", F.expr("try_cast(id AS BIGINT)").alias("id")).where("id >= 1").groupBy("id").agg(F.min("position").alias("position"))
    lists = [F.coalesce(f"distilled.{name}", F.array().cast("array<string>")).alias(name) for name in (
        "what_happened", "important_facts", "decisions_or_conclusions", "open_questions_or_next_steps", "people_organizations_equipment", "tags")]
    return numbered_by_range(pages, [], list(order), "id").join(wanted, "id").select(
        "position", "id", (F.lit(100) - F.col("id")).alias("score"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("section", "title", "html", "source_sha256")],
        F.coalesce("distilled.one_sentence_summary", F.lit("")).alias("summary"), *lists,
        F.slice(F.coalesce("attachments", F.array().cast("array<string>")), 1, 10).alias("attachments"))


def select_candidates(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """Candidates whose id was selected, in candidate order."""
    return candidates.join(selected.select("chunk_id").distinct(), "chunk_id", "left_semi")
