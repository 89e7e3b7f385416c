"""The chunk index and the rankers over it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorebase.catalogue.registry import CHUNKS, FOLDED, ORACLE, SOURCES, compact, count_of, fold, lexical, query, quoted
from lorebase.catalogue.texts import DISTILLED, distilled_documents
from lorebase.functions import scoring as S
from lorebase.functions.text import compact as flat
from lorebase.functions.text import sha256
from lorebase.operators import indexing, postings, search
from lorebase.session import persist_table, shared_folder
from lorebase.sources.adapters import (
    conversation_sources, document_sources, page_sources, query_vector, table, url_path,
)

QUESTION = "Released under the MIT License"
TERMS = ["released", "under", "the", "mit", "license"]
QUESTIONS = ["Released under the MIT License", "which token is in this version 2.0", "la elle pour que", "heit und nicht"]
QUESTION_TERMS = [
    ["released", "under", "the", "mit", "license"], ["which", "token", "is", "in", "this", "version", "2.0"],
    ["la", "elle", "pour", "que"], ["heit", "und", "nicht"],
]


def document_chunks(spark, folder):
    return indexing.chunk_sources(document_sources(table(spark, folder, "documents")))


@query("chunk_index", f"""
    WITH RECURSIVE {CHUNKS} SELECT chunk_id, chunk_index::BIGINT AS chunk_index, source_id, text_hash, text FROM chunks""")
def chunk_index(spark, folder):
    return document_chunks(spark, folder).select(
        "chunk_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "source_id", "text_hash", "text"
    )


@query("source_union", f"""
    WITH u AS ({SOURCES.replace('SELECT doc_id', 'SELECT doc_id')}),
    chat AS (SELECT 'chat' AS source_type, text FROM conversations)
    SELECT CASE WHEN source_type LIKE 'src%' THEN 'document' ELSE source_type END AS source_type, count(*) AS sources
    FROM (SELECT source_type, text FROM u UNION ALL SELECT * FROM chat UNION ALL SELECT 'source_html', html FROM pages)
    WHERE {compact('text')} <> '' GROUP BY 1""")
def source_union(spark, folder):
    union = indexing.union_sources(
        document_sources(table(spark, folder, "documents")), page_sources(table(spark, folder, "pages")),
        conversation_sources(table(spark, folder, "conversations")),
    )
    kind = F.when(F.startswith("source_type", F.lit("src")), "document").otherwise(F.col("source_type"))
    return union.groupBy(kind.alias("source_type")).agg(F.count("*").alias("sources"))


_TOP = "ORDER BY score DESC, lexical_score DESC, ordinal, chunk_index"
_SNIP = compact("text")


@query("lexical_topk", f"""
    WITH RECURSIVE {CHUNKS}, {FOLDED}, scored AS (SELECT *, {lexical(QUESTION, TERMS)} AS lex FROM folded),
    top AS (SELECT *, round(lex, 4) AS lexical_score, round(CASE WHEN lex > 0 THEN lex / (lex + 10.0) ELSE 0 END, 6) AS score
            FROM scored WHERE lex > 0 {_TOP} LIMIT 40),
    hit AS (SELECT *, {_SNIP} AS t FROM top),
    placed AS (SELECT *, coalesce(least({', '.join(f"nullif(instr({fold('t')}, {quoted(w)}), 0)" for w in TERMS)}), 1) AS pos FROM hit)
    SELECT chunk_id, source_id, chunk_index::BIGINT AS chunk_index, lexical_score, score, substr(t, greatest(0, pos - 301) + 1, 900) AS snippet FROM placed""")
def lexical_topk(spark, folder):
    top = search.with_snippet(search.rank_chunks(document_chunks(spark, folder), QUESTION), QUESTION)
    return top.select(
        "chunk_id", "source_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "lexical_score", "score", "snippet"
    )


@query("question_set_topk", f"""
    WITH RECURSIVE {CHUNKS}, {FOLDED}, scored AS ({' UNION ALL '.join(
        f"SELECT {n} AS question_no, ordinal, chunk_index, chunk_id, {lexical(q, t)} AS lex FROM folded"
        for n, (q, t) in enumerate(zip(QUESTIONS, QUESTION_TERMS), start=1))}),
    ranked AS (SELECT *, round(lex, 4) AS lexical_score, round(lex / (lex + 10.0), 6) AS score FROM scored WHERE lex > 0),
    top AS (SELECT *, row_number() OVER (PARTITION BY question_no {_TOP}) AS rank FROM ranked)
    SELECT question_no::BIGINT AS question_no, rank, chunk_id, lexical_score, score FROM top WHERE rank <= 10""")
def question_set_topk(spark, folder):
    top = search.rank_question_set(document_chunks(spark, folder), QUESTIONS)
    return top.select(
        F.col("question_no").cast("bigint").alias("question_no"), F.col("rank").cast("bigint").alias("rank"), "chunk_id",
        "lexical_score", "score",
    )


_QUERY_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


@query("semantic_topk", f"""
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}), 6) AS similarity, label FROM embeddings
    ORDER BY similarity DESC, vec_id LIMIT 40""")
def semantic_topk(spark, folder):
    vectors = table(spark, folder, "embeddings")
    top = search.nearest(vectors, query_vector(vectors), "vec_id", "embedding", 40)
    return top.select("vec_id", "similarity", "label")


@query("section_route", f"""
    WITH near AS (SELECT label, round(list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}), 6) AS similarity, vec_id
        FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 25)
    SELECT label, count(*) AS votes, round(max(similarity), 4) AS best FROM near GROUP BY label""")
def section_route(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return search.route_by_neighbours(vectors, query_vector(vectors), "vec_id", "embedding", "label", 25)


def vectored_chunks(spark, folder):
    """Chunks with the vector of their document, where there is one (vec_id = doc_id)."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"))
    return document_chunks(spark, folder).join(vectors, "ordinal", "left")


@query("hybrid_topk", f"""
    WITH RECURSIVE {CHUNKS}, {FOLDED}, scored AS (
        SELECT folded.*, {lexical(QUESTION, TERMS)} AS lex,
               coalesce(list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}), 0) AS sem
        FROM folded LEFT JOIN embeddings ON vec_id = ordinal),
    final AS (SELECT *, round(lex, 4) AS lexical_score, round(sem, 6) AS semantic_score,
        round(0.68::DOUBLE * greatest(0, sem) + 0.32::DOUBLE * (CASE WHEN lex > 0 THEN lex / (lex + 10.0) ELSE 0 END), 6) AS score FROM scored)
    SELECT chunk_id, lexical_score, semantic_score, score FROM final WHERE score > 0 OR lexical_score > 0 {_TOP} LIMIT 40""")
def hybrid_topk(spark, folder):
    vector = query_vector(table(spark, folder, "embeddings"))
    top = search.rank_chunks(vectored_chunks(spark, folder), QUESTION, vector)
    return top.select("chunk_id", "lexical_score", "semantic_score", "score")


def stored_index(spark, chunks):
    """An index version as a run would leave it; blocks are small so that the small tables have several."""
    path = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    postings.write_blocks(chunks, path, 256)
    return postings.Blocks(spark.read.parquet(path), spark.read.parquet(f"{path}-grams"))


@query("stored_lexical_topk", ORACLE["lexical_topk"])
def stored_lexical_topk(spark, folder):
    """The flagship question over a stored index."""
    top = search.with_snippet(stored_index(spark, document_chunks(spark, folder)).rank(QUESTION), QUESTION)
    return top.select("chunk_id", "source_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "lexical_score", "score", "snippet")


@query("stored_hybrid_topk", ORACLE["hybrid_topk"])
def stored_hybrid_topk(spark, folder):
    vector = query_vector(table(spark, folder, "embeddings"))
    top = stored_index(spark, vectored_chunks(spark, folder)).rank(QUESTION, vector)
    return top.select("chunk_id", "lexical_score", "semantic_score", "score")


@query("evidence_records", f"""
    WITH RECURSIVE {CHUNKS}, {FOLDED}, scored AS (SELECT *, {lexical(QUESTION, TERMS)} AS lex FROM folded),
    top AS (SELECT *, round(lex, 4) AS lexical_score, round(lex / (lex + 10.0), 6) AS score FROM scored WHERE lex > 0 {_TOP} LIMIT 8)
    SELECT chunk_id AS id, score, section, title, substr({_SNIP}, 1, 260) AS summary, substr({_SNIP}, 1, 1200) AS important_facts,
           source_type AS tags, substr({_SNIP}, 1, 1400) AS source_snippet FROM top""")
def evidence_records(spark, folder):
    top = search.rank_chunks(document_chunks(spark, folder), QUESTION, top_k=8)
    records = search.evidence(top)
    return records.select("id", "score", "section", "title", "summary", F.array_join("important_facts", "|").alias("important_facts"), F.array_join("tags", "|").alias("tags"), "source_snippet")


# --- vector reuse -------------------------------------------------------------------------------------------------
@query("vector_reuse", f"""
    WITH RECURSIVE {CHUNKS}, old AS (SELECT DISTINCT text_hash FROM chunks JOIN labels ON doc_id = ordinal)
    SELECT count(*) AS chunk_count, count(DISTINCT chunks.text_hash) AS distinct_texts,
           count(old.text_hash) AS reused_vectors, count(*) - count(old.text_hash) AS missing_vectors
    FROM chunks LEFT JOIN old USING (text_hash)""")
def vector_reuse(spark, folder):
    """The previous index held the labelled documents; what of today's index can keep its vectors?"""
    chunks = persist_table(document_chunks(spark, folder).select("ordinal", "text_hash"), "chunks")  # chunked once, read twice
    labelled = table(spark, folder, "labels").select(F.col("doc_id").alias("ordinal"))
    return indexing.reuse_counts(chunks, chunks.join(labelled, "ordinal", "left_semi"))


@query("index_manifest", f"""
    WITH RECURSIVE {CHUNKS}, old AS (SELECT DISTINCT text_hash FROM chunks JOIN embeddings ON vec_id = ordinal)
    SELECT count(DISTINCT source_id) AS source_count, count(*) AS chunk_count, count(old.text_hash) AS chunks_with_vectors,
           count(old.text_hash) AS reused_vectors, 0::BIGINT AS embedded_chunks FROM chunks LEFT JOIN old USING (text_hash)""")
def index_manifest(spark, folder):
    """Today's chunks take over the vectors of a previous index that knew the documents with an embedding."""
    old = vectored_chunks(spark, folder).filter(F.col("vector").isNotNull())
    index = indexing.reuse_vectors(document_chunks(spark, folder), old)
    return indexing.index_manifest(index.withColumn("reused", F.col("vector").isNotNull()))


# --- page, memory and file search ---------------------------------------------------------------------------------
PAGE_QUESTION = "apache license token"
PAGE_TERMS = ["apache", "license", "token"]


def distilled_pages(spark, folder):
    empty = F.array().cast("array<string>")
    return distilled_documents(spark, folder).select(
        "ordinal", "section", "title", empty.alias("attachments"),
        F.struct(
            F.col("summary").alias("one_sentence_summary"), empty.alias("what_happened"), F.col("important_facts"),
            empty.alias("decisions_or_conclusions"), F.col("next_steps_or_questions").alias("open_questions_or_next_steps"),
            empty.alias("people_organizations_equipment"), F.col("tags"),
        ).alias("distilled"),
    )


_FIELDS = {
    "title": ("title", 5.0), "section": ("section", 3.0), "first_sentence": ("coalesce(first_sentence, '')", 3.0),
    "facts": ("array_to_string(facts, chr(10))", 2.5), "steps": ("array_to_string(steps, chr(10))", 2.0),
    "tags": ("array_to_string(tags, chr(10))", 2.0),
}
_PAGE_SCORE = " + ".join(
    f"(CASE WHEN contains({fold(expr)}, {quoted(t)}) THEN {weight} ELSE 0 END)::DOUBLE"
    for expr, weight in _FIELDS.values() for t in PAGE_TERMS
)
_PAGE_HAY = fold("title || chr(10) || section || chr(10) || coalesce(first_sentence, '') || chr(10) || chr(10) || array_to_string(facts, chr(10)) "
                 "|| chr(10) || chr(10) || array_to_string(steps, chr(10)) || chr(10) || chr(10) || array_to_string(tags, chr(10))")
_PAGE_RANKED = f"""{DISTILLED}, ranked AS (
    SELECT ordinal, section, title, round({_PAGE_SCORE} + (CASE WHEN contains({_PAGE_HAY}, {quoted(PAGE_QUESTION)}) THEN 12.0 ELSE 0 END)::DOUBLE, 4) AS score
    FROM distilled ORDER BY score DESC, ordinal LIMIT 5)"""


@query("page_field_rank", f"WITH {_PAGE_RANKED} SELECT ordinal AS doc_id, section, title, score FROM ranked WHERE score > 0")
def page_field_rank(spark, folder):
    hits = search.rank_pages(distilled_pages(spark, folder), PAGE_QUESTION, "ordinal")
    return hits.select(F.col("ordinal").alias("doc_id"), "section", "title", "score")


@query("answer_bands", f"""
    WITH {_PAGE_RANKED}, best AS (SELECT coalesce(max(score), 0) AS top_score, count(*) AS evidence_count FROM ranked WHERE score > 0)
    SELECT *, CASE WHEN top_score >= 20 THEN 'yes' WHEN top_score >= 8 THEN 'likely' ELSE 'unknown' END AS likely_done_before,
        CASE WHEN top_score >= 20 THEN 'high' WHEN top_score >= 8 THEN 'medium' ELSE 'low' END AS confidence,
        evidence_count > 0 AND top_score >= 8 AS clear_evidence FROM best""")
def answer_bands(spark, folder):
    bands = search.answer_bands(search.rank_pages(distilled_pages(spark, folder), PAGE_QUESTION, "ordinal"))
    clear = S.clear_evidence(F.col("evidence_count"), F.col("likely_done_before"), F.col("confidence"), F.col("top_score"))
    return bands.withColumn("clear_evidence", clear)


MEMORY_QUERY = "src3 Apache License, token elle"
_MEMORY_TOKENS = ["src3", "apache", "license", "token", "elle"]
_MEMORY_POINTS = " + ".join(
    f"{count_of('hay', t)} + (CASE WHEN contains(tags, {quoted(t)}) THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(title), {quoted(t)}) THEN 5 ELSE 0 END)"
    for t in _MEMORY_TOKENS
)


@query("memory_rank", f"""
    WITH entries AS (SELECT 'doc-' || doc_id AS id, {compact('substr(text, 1, 80)')} AS title, {compact('text')} AS body_text,
        substr(sha256(text), 1, 12) AS path, lang, source FROM documents),
    hay AS (SELECT *, '[''' || lang || ''', ''' || source || ''']' AS tags, lower(id || chr(10) || title || chr(10) || 'document' || chr(10) || 'active'
        || chr(10) || chr(10) || chr(10) || chr(10) || lang || ' ' || source || chr(10) || chr(10) || body_text) AS hay FROM entries)
    SELECT id, ({_MEMORY_POINTS})::BIGINT AS points, CASE WHEN length(body_text) <= 220 THEN body_text
        ELSE rtrim(substr(body_text, 1, 217)) || '...' END AS snippet FROM hay WHERE ({_MEMORY_POINTS}) > 0 ORDER BY points DESC, path LIMIT 10""")
def memory_rank(spark, folder):
    none = F.array().cast("array<string>")
    entries = table(spark, folder, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), flat(F.substring("text", 1, 80)).alias("title"),
        F.lit("document").alias("type"), F.lit("active").alias("status"), F.lit("").alias("date"), none.alias("projects"),
        none.alias("people"), F.array("lang", "source").alias("tags"), F.lit("").alias("summary"),
        flat(F.col("text")).alias("body_text"), sha256(F.col("text"), 12).alias("path"),
    )
    return search.rank_memory(entries, MEMORY_QUERY).select("id", "points", "snippet")


FILE_REQUEST = "send the tion manual for spam-farm html"
_FILE_TERMS = ["send", "the", "tion", "for", "spam-farm", "html"]


@query("file_rank", f"""
    WITH files AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, {fold('url || chr(10) || html')} AS hay FROM pages),
    scored AS (SELECT page_id, url, {' + '.join(f"contains(hay, {quoted(t)})::INT" for t in _FILE_TERMS)} + (CASE WHEN regexp_matches(path, '[.]pdf$') THEN 2 ELSE 0 END) AS score FROM files)
    SELECT page_id, url AS path, score::BIGINT AS score FROM scored WHERE score > 0 ORDER BY score DESC, lpad(page_id::VARCHAR, 12, '0') DESC, url LIMIT 3""")
def file_rank(spark, folder):
    from lorebase.functions.text import casefold

    files = table(spark, folder, "pages").select(
        "page_id", F.col("url").alias("path"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("created_at"),
        casefold(F.concat_ws("\n", "url", "html")).alias("haystack"), url_path(F.col("url")).alias("file_path"),
    )
    return search.rank_files(files, FILE_REQUEST).select("page_id", "path", F.col("score").cast("bigint").alias("score"))
