"""Text functions over whole documents, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase import rules
from lorebase.catalogue.registry import SOURCES, compact, fold, matches, query, quoted, redact, strip
from lorebase.functions import distill as D
from lorebase.functions import intent as I
from lorebase.functions import nested
from lorebase.functions import scoring as S
from lorebase.functions import terms as Q
from lorebase.functions import text as T
from lorebase.functions import values as V
from lorebase.operators import digest, distill, grouping, indexing, publish
from lorebase.sources.adapters import document_sources, table


@query("redact_documents", f"""
    SELECT doc_id, {redact('text')} AS redacted FROM documents""")
def redact_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


@query("redact_chat_rules", f"""
    SELECT conv_id, turn, {redact('text', rules.PUSH_CHAT_REDACTION)} AS pushed,
           {redact('text', rules.POLLED_CHAT_REDACTION)} AS polled FROM conversations""")
def redact_chat_rules(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", T.redact(F.col("text"), rules.PUSH_CHAT_REDACTION).alias("pushed"),
        T.redact(F.col("text"), rules.POLLED_CHAT_REDACTION).alias("polled"),
    )


@query("normalize_text", f"""
    SELECT doc_id, {compact('text')} AS flat,
           {strip("regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS export,
           {compact(f"regexp_replace(text, '#+{rules.SPACE}*', '', 'g')")} AS entry FROM documents""")
def normalize_text(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", T.compact(text).alias("flat"), T.normalise_export(text).alias("export"), T.normalise_entry(text).alias("entry")
    )


@query("content_hash_dupes", """
    SELECT sha256(text) AS source_hash, count(*) AS copies, min(doc_id) AS first_ordinal FROM documents
    GROUP BY 1 HAVING count(*) > 1""")
def content_hash_dupes(spark, folder):
    return indexing.content_copies(table(spark, folder, "documents").withColumnRenamed("doc_id", "ordinal"))


@query("fingerprints", """
    SELECT doc_id, substr(sha256(text), 1, 12) AS h12, substr(sha256(text), 1, 16) AS h16,
           'distilled:' || substr(sha256(lang || '/' || source || '/' || text), 1, 16) AS distilled_id FROM documents""")
def fingerprints(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", T.sha256(text, 12).alias("h12"), T.sha256(text, rules.ARCHIVE_HASH_HEX).alias("h16"),
        T.source_id("distilled", F.concat_ws("/", "lang", "source", "text"), rules.DISTILLED_ID_HEX).alias("distilled_id"),
    )


TOKEN_PATTERN = r"""(?i)token\s*[:=]\s*['"][^'"]{8,}['"]"""


@query("secret_scan", f"""
    SELECT doc_id, {matches('text', rules.PUBLISH_SECRET_PATTERNS)} AS publish_secret,
           {matches('text', [TOKEN_PATTERN])} AS token_secret FROM documents""")
def secret_scan(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", publish.has_secret(F.col("text")).alias("publish_secret"),
        T.matches_any(F.col("text"), [TOKEN_PATTERN]).alias("token_secret"),
    )


@query("publish_gate", f"""
    SELECT doc_id, CASE WHEN lang = 'fr' OR (lang = 'es' AND source <> 'src3') THEN 'private path'
        WHEN strlen(text) > {rules.PUBLISH_MAX_BYTES} THEN 'file exceeds the size limit'
        WHEN {matches('text', rules.PUBLISH_SECRET_PATTERNS)} THEN 'possible embedded credential' ELSE '' END AS problem
    FROM documents""")
def publish_gate(spark, folder):
    docs = table(spark, folder, "documents")
    files = docs.select(
        "doc_id", F.concat_ws("/", "lang", "source").alias("path"), F.octet_length("text").alias("size"), "text",
        F.contains(F.col("text"), F.lit("\x00")).alias("binary"),
    )
    return publish.publish_verdict(files, prefixes=["fr/"], controlled=["es/"], exceptions=["es/src3"]).select("doc_id", "problem")


@query("term_extract", f"""
    WITH hits AS (SELECT item_id, {fold('unnest(found)')} AS term, generate_subscripts(found, 1) AS pos
                  FROM (SELECT item_id, regexp_extract_all(text, '{rules.LATIN_TERM}') AS found FROM benchmark))
    SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY min(pos)) AS position
    FROM hits GROUP BY item_id, term""")
def term_extract(spark, folder):
    terms = table(spark, folder, "benchmark").select("item_id", F.posexplode(Q.terms_column(F.col("text"))).alias("p", "term"))
    return terms.select("item_id", "term", (F.col("p") + 1).cast("bigint").alias("position"))


@query("word_tokens", r"""
    SELECT item_id, len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda t: t <> ''))::BIGINT AS tokens
    FROM benchmark""")
def word_tokens(spark, folder):
    return table(spark, folder, "benchmark").select("item_id", F.size(Q.word_tokens_column(F.col("text"))).cast("bigint").alias("tokens"))


SNIPPET_TERMS = ["license", "token", "nicht", "elle", "ción", "that"]
_FLAT = compact("text")


@query("snippets", f"""
    WITH flat AS (SELECT doc_id, {_FLAT} AS t FROM documents),
    hit AS (SELECT doc_id, t, coalesce(least({', '.join(f"nullif(instr({fold('t')}, {quoted(w)}), 0)" for w in SNIPPET_TERMS)}), 1) AS pos FROM flat)
    SELECT doc_id, substr(t, greatest(0, pos - 1 - 300) + 1, 900) AS snippet FROM hit""")
def snippets(spark, folder):
    return table(spark, folder, "documents").select("doc_id", S.snippet(F.col("text"), SNIPPET_TERMS).alias("snippet"))


@query("reply_pieces", """
    SELECT conv_id, turn, p AS piece_no, substr(text, p * 300 + 1, 300) AS piece
    FROM (SELECT conv_id, turn, text, unnest(range(0, greatest(1, (length(text) + 299) // 300))) AS p FROM conversations)""")
def reply_pieces(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.posexplode(T.split_reply(F.col("text"), 300)).alias("piece_no", "piece")
    ).withColumn("piece_no", F.col("piece_no").cast("bigint"))


# --- local distillation ----------------------------------------------------------------------------------------
KEYWORDS = (("apache", "apache"), ("license", "license"), ("token", "token"), ("nicht", "german"), ("elle", "french"),
            ("ción", "spanish"), ("tion", "suffix"), ("heit", "noun"), ("released", "released"))
OUTCOMES = ("license", "version", "token")
STEPS = ("this", "pour", "nicht", "para")
SENTENCES = f"""list_transform(list_filter(string_split(regexp_replace(text, '([。！？.!?]){rules.SPACE}+|\\n+', '\\1' || chr(1), 'g'), chr(1)),
    lambda s: length({strip('s')}) > 8), lambda s: {compact('s')})"""


def _any(x, words):
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


_POINTS = f"""(CASE WHEN regexp_matches(s, {quoted(rules.FACT_PATTERN)}) THEN 3 ELSE 0 END
    + CASE WHEN {_any(fold('s'), OUTCOMES)} THEN 2 ELSE 0 END + CASE WHEN length(s) BETWEEN 20 AND 260 THEN 1 ELSE 0 END)"""
DISTILLED = f"""
    src AS ({SOURCES}),
    split AS (SELECT *, {SENTENCES} AS sents FROM src),
    distilled AS (
        SELECT ordinal, section, title, text, substr(sents[1], 1, 320) AS first_sentence, sents,
          list_transform(list_sort(list_filter(list_transform(sents, lambda s, i: {{'r': -{_POINTS}, 'n': length(s), 'i': i, 's': s}}),
              lambda e: e.r < 0))[1:8], lambda e: e.s) AS facts,
          list_filter(sents, lambda s: {_any(fold('s'), STEPS)})[1:6] AS steps,
          list_filter([{', '.join(f"CASE WHEN contains({fold('section || chr(10) || title || chr(10) || text')}, {quoted(k)}) THEN {quoted(v)} END" for k, v in KEYWORDS)}],
              lambda t: t IS NOT NULL)[1:12] AS tags FROM split
    )"""


def distilled_documents(spark, folder):
    sources = document_sources(table(spark, folder, "documents")).select("ordinal", "section", "title", "text")
    return distill.distill_pages(sources, KEYWORDS, OUTCOMES, STEPS)


@query("sentence_facts", f"""
    WITH {DISTILLED} SELECT ordinal AS doc_id, generate_subscripts(facts, 1) AS position, unnest(facts) AS fact FROM distilled""")
def sentence_facts(spark, folder):
    docs = document_sources(table(spark, folder, "documents")).select("ordinal", D.sentences(F.col("text")).alias("s"))
    facts = docs.select(F.col("ordinal").alias("doc_id"), F.posexplode(D.important_facts(F.col("s"), OUTCOMES)).alias("p", "fact"))
    return facts.select("doc_id", (F.col("p") + 1).cast("bigint").alias("position"), "fact")


@query("next_steps", f"""
    WITH {DISTILLED} SELECT ordinal AS doc_id, generate_subscripts(steps, 1) AS position, unnest(steps) AS step FROM distilled""")
def next_steps(spark, folder):
    docs = document_sources(table(spark, folder, "documents")).select("ordinal", D.sentences(F.col("text")).alias("s"))
    steps = docs.select(F.col("ordinal").alias("doc_id"), F.posexplode(D.next_steps(F.col("s"), STEPS)).alias("p", "step"))
    return steps.select("doc_id", (F.col("p") + 1).cast("bigint").alias("position"), "step")


@query("keyword_tags", f"""
    WITH {DISTILLED} SELECT ordinal AS doc_id, array_to_string(tags, ',') AS tags FROM distilled""")
def keyword_tags(spark, folder):
    docs = document_sources(table(spark, folder, "documents"))
    text = F.concat_ws("\n", "section", "title", "text")
    return docs.select(F.col("ordinal").alias("doc_id"), F.array_join(D.keyword_tags(text, KEYWORDS), ",").alias("tags"))


@query("local_distillation", f"""
    WITH {DISTILLED} SELECT ordinal AS doc_id, CASE WHEN len(sents) > 0 THEN first_sentence WHEN {compact('text')} <> ''
        THEN substr({compact('text')}, 1, 320) ELSE 'No readable text extracted for ' || title || '.' END AS summary,
        array_to_string(tags, ',') AS tags, len(facts)::BIGINT AS facts, len(steps)::BIGINT AS steps,
        length(text)::BIGINT AS text_characters FROM distilled""")
def local_distillation(spark, folder):
    return distilled_documents(spark, folder).select(
        F.col("ordinal").alias("doc_id"), "summary", F.array_join("tags", ",").alias("tags"),
        F.size("important_facts").cast("bigint").alias("facts"), F.size("next_steps_or_questions").cast("bigint").alias("steps"),
        F.col("text_characters").cast("bigint").alias("text_characters"),
    )


SECTION_TAGS = f"""{DISTILLED},
    tag_rows AS (SELECT section, ordinal, generate_subscripts(tags, 1) AS position, unnest(tags) AS tag FROM distilled),
    tag_counts AS (SELECT section, tag, count(*) AS pages, min(ordinal * 100 + position) AS first FROM tag_rows GROUP BY 1, 2),
    tag_ranks AS (SELECT section, tag, pages, row_number() OVER (PARTITION BY section ORDER BY pages DESC, first) AS rank FROM tag_counts)"""


@query("section_tags", f"WITH {SECTION_TAGS} SELECT section, tag, pages, rank FROM tag_ranks WHERE rank <= 12")
def section_tags(spark, folder):
    ranked = distill.section_tags(distilled_documents(spark, folder))
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


@query("section_rollup", f"""
    WITH {SECTION_TAGS},
    fact_rows AS (SELECT section, ordinal, generate_subscripts(facts[1:2], 1) AS position, unnest(facts[1:2]) AS fact FROM distilled),
    fact_ranks AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY ordinal, position) AS rank FROM fact_rows),
    tag_lists AS (SELECT section, string_agg(tag, ', ' ORDER BY rank) AS top_tags,
                  string_agg(tag, ', ' ORDER BY rank) FILTER (rank <= 8) AS named FROM tag_ranks WHERE rank <= 12 GROUP BY 1),
    fact_lists AS (SELECT section, string_agg(fact, ' | ' ORDER BY rank) AS highlight_facts FROM fact_ranks WHERE rank <= 12 GROUP BY 1),
    counted AS (SELECT section, count(*) AS page_count FROM distilled GROUP BY 1)
    SELECT section, page_count, section || ' contains ' || page_count || ' pages. Main tags: ' || coalesce(named, 'none detected') || '.' AS summary,
           coalesce(top_tags, '') AS top_tags, coalesce(highlight_facts, '') AS highlight_facts
    FROM counted LEFT JOIN tag_lists USING (section) LEFT JOIN fact_lists USING (section)""")
def section_rollup(spark, folder):
    return distill.section_rollup(distilled_documents(spark, folder)).select(
        "section", "page_count", "summary", F.array_join("top_tags", ", ").alias("top_tags"),
        F.array_join("highlight_facts", " | ").alias("highlight_facts"),
    )


def _merged(column):
    return f"""SELECT notebook, ordinal, position, item, row_number() OVER (PARTITION BY notebook, section ORDER BY ordinal, position) AS place FROM (
        SELECT notebook, section, ordinal, generate_subscripts({column}[1:2], 1) AS position, unnest({column}[1:2]) AS item FROM book)"""


@query("notebook_rollup", f"""
    WITH {DISTILLED}, book AS (SELECT *, 'notebook-' || ordinal % 3 AS notebook FROM distilled),
    tag_rows AS (SELECT notebook, ordinal, generate_subscripts(tags, 1) AS position, unnest(tags) AS tag FROM book),
    tag_ranks AS (SELECT notebook, tag, row_number() OVER (PARTITION BY notebook ORDER BY pages DESC, first) AS rank FROM (
        SELECT notebook, tag, count(*) AS pages, min(ordinal * 100 + position) AS first FROM tag_rows GROUP BY 1, 2)),
    topics AS (SELECT notebook, string_agg(tag, ', ' ORDER BY rank) AS top_topics, string_agg(tag, ', ' ORDER BY rank) FILTER (rank <= 8) AS named
        FROM tag_ranks WHERE rank <= 12 GROUP BY 1),
    facts AS (SELECT notebook, string_agg(item, ' | ' ORDER BY rank) AS highlight_facts FROM (
        SELECT *, row_number() OVER (PARTITION BY notebook ORDER BY place, ordinal, position) AS rank FROM ({_merged('facts')}) WHERE place <= 12) WHERE rank <= 12 GROUP BY 1),
    steps AS (SELECT notebook, string_agg(item, ' | ' ORDER BY rank) AS open_questions FROM (
        SELECT *, row_number() OVER (PARTITION BY notebook ORDER BY place, ordinal, position) AS rank FROM ({_merged('steps')}) WHERE place <= 12) WHERE rank <= 12 GROUP BY 1),
    counted AS (SELECT notebook, count(*) AS page_count, count(DISTINCT section) AS section_count FROM book GROUP BY 1)
    SELECT notebook, section_count, page_count, notebook || ' contains ' || page_count || ' pages in ' || section_count || ' sections. Main topics: '
        || coalesce(named, 'none detected') || '.' AS summary, coalesce(top_topics, '') AS top_topics, coalesce(highlight_facts, '') AS highlight_facts,
        coalesce(open_questions, '') AS open_questions
    FROM counted LEFT JOIN topics USING (notebook) LEFT JOIN facts USING (notebook) LEFT JOIN steps USING (notebook)""")
def notebook_rollup(spark, folder):
    """Three notebooks, a section per language."""
    pages = distilled_documents(spark, folder).withColumn("notebook", F.concat(F.lit("notebook-"), F.col("ordinal") % 3))
    joined = [F.array_join(c, sep).alias(c) for c, sep in (("top_topics", ", "), ("highlight_facts", " | "), ("open_questions", " | "))]
    return distill.notebook_rollup(pages).select("notebook", "section_count", "page_count", "summary", *joined)


# A value per turn: lists in objects in lists, with nulls, empty lists and a depth that grows with the turn.
def _nested():
    text, turn = F.to_json(F.array("text")), F.col("turn").cast("string")
    quoted = F.substring(text, F.lit(2), F.length(text) - 2)
    inner = F.concat(F.lit('{"chat" : '), F.col("conv_id"), F.lit(', "none":null,"turn":{"role":"'), F.col("role"), F.lit('","parts":[null,'), quoted, F.lit(', {"again":'), quoted,
                     F.lit(',"gone": null ,"deep":[['), turn, F.lit(',true,null],[]]}]}}'))
    depth = (F.col("turn") % 5).cast("int")
    return F.concat(F.repeat(F.lit('[{"n\\"ull":'), depth), inner, F.repeat(F.lit("}]"), depth))


_LINES = """repeat('n"ull: ', (turn % 5)::INT) || 'chat: ' || conv_id || chr(10) || 'turn: role: ' || role || chr(10) || 'parts: ' || {0} || chr(10) || 'again: ' || {0} || chr(10) || 'deep: ' || turn || chr(10) || 'True' || chr(10)"""
_SECRETIVE = """(text || CASE WHEN turn % 3 = 0 THEN chr(10) || 'token = ' || chr(92) || '"x' || turn ELSE '' END)"""


@query("nested_values", f"""
    WITH t AS (SELECT conv_id, turn, role, {_SECRETIVE} AS text FROM conversations)
    SELECT conv_id, turn, {_LINES.format('text')} AS flat, {_LINES.format(redact('text'))} AS redacted,
        CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN text || '|' || {redact('text')} WHEN 2 THEN 'role: ' || role || '|text: ' || text || '|none: None' ELSE text END AS listed FROM t""")
def nested_values(spark, folder):
    """Values as deep as their turn, flattened, redacted inside and then flattened, and coerced to lists."""
    more = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('\ntoken = \\"x'), F.col("turn"))).otherwise("")
    turns = table(spark, folder, "conversations").withColumn("text", F.concat("text", more))
    quoted = F.to_json(F.array("text"))
    kinds = (F.when(F.col("turn") % 4 == 0, F.lit("null")).when(F.col("turn") % 4 == 1, F.to_json(F.array("text", T.redact(F.col("text")))))
             .when(F.col("turn") % 4 == 2, F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","text":'), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(',"none":null}')))
             .otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2)))
    rows = turns.select("conv_id", "turn", _nested().alias("value"), kinds.alias("kind"))
    return rows.select("conv_id", "turn", nested.flatten_json(F.col("value")).alias("flat"), nested.flatten_json(nested.redact_json(F.col("value"))).alias("redacted"),
                       F.array_join(nested.list_json(F.col("kind")), "|").alias("listed"))


# --- names, files, entries --------------------------------------------------------------------------------------
_IMPORT = "trim(regexp_replace(lower({0}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '-', 'g'), '-')"


@query("slug_names", f"""
    WITH named AS (SELECT p_partkey, p_name, {_IMPORT.format('p_name')} AS s,
        trim(regexp_replace(lower({strip('p_name')}), '[^a-z0-9._@+-]+', '_', 'g'), '._-') AS m,
        trim(regexp_replace({strip('p_name')}, '[^A-Za-z0-9\\x{{4e00}}-\\x{{9fff}}._-]+', '_', 'g'), '._-') AS f,
        trim(regexp_replace({compact('p_name')}, '[^\\p{{L}}\\p{{N}}_ .,+()-]+', '_', 'g'), ' ._-') AS t FROM part)
    SELECT p_partkey, trim(substr(CASE WHEN s = '' THEN 'imported-note' ELSE s END, 1, 60), '-') AS import_slug,
           CASE WHEN substr(m, 1, 80) = '' THEN 'unknown' ELSE substr(m, 1, 80) END AS mail_slug,
           CASE WHEN substr(f, 1, 80) = '' THEN 'unknown' ELSE substr(f, 1, 80) END AS folder,
           CASE WHEN substr(t, 1, 80) = '' THEN 'general' ELSE substr(t, 1, 80) END AS topic FROM named""")
def slug_names(spark, folder):
    name = F.col("p_name")
    return table(spark, folder, "part").select(
        "p_partkey", T.slug_import(name).alias("import_slug"), T.slug_mail(name).alias("mail_slug"),
        T.safe_name(name).alias("folder"), T.slug_topic(name).alias("topic"),
    )


@query("unique_names", """
    WITH base AS (SELECT doc_id, lang || '-' || source AS name FROM documents),
    counted AS (SELECT doc_id, name, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS n FROM base)
    SELECT doc_id, CASE WHEN n = 1 THEN name ELSE name || '-' || n END AS unique_name FROM counted""")
def unique_names(spark, folder):
    names = table(spark, folder, "documents").select("doc_id", F.concat_ws("-", "lang", "source").alias("name"))
    counted = grouping.numbered_within(names, ["name"], ["doc_id"], F.floor(F.col("doc_id") / grouping.ROWS_PER_BLOCK), "n")
    return counted.select(
        "doc_id", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat_ws("-", "name", "n")).alias("unique_name")
    )


_EXPORT = strip("text")
_BREAK = "(CASE WHEN instr(reverse(substr(rest, 1, 5000)), chr(10)) > 0 THEN 5000 - instr(reverse(substr(rest, 1, 5000)), chr(10)) ELSE -1 END)"
_AT = f"(CASE WHEN {_BREAK} >= 2500 THEN {_BREAK} ELSE 5000 END)"
EXPORTED = f"""
    files AS (SELECT doc_id, lang || '-' || source AS stem, substr(sha256(text), 1, 16) AS hash, {_EXPORT} AS body FROM documents),
    cut AS (
        SELECT doc_id, 1 AS n, body AS rest, NULL::VARCHAR AS piece FROM files
        UNION ALL
        SELECT doc_id, n + 1, {strip(f'substr(rest, {_AT} + 1)')}, {strip(f'substr(rest, 1, {_AT})')} FROM cut WHERE length(rest) > 5000
    ),
    pieces AS (
        SELECT doc_id, n - 1 AS chunk_index, piece AS chunk FROM cut WHERE piece IS NOT NULL
        UNION ALL SELECT doc_id, n, rest FROM cut WHERE length(rest) <= 5000 AND rest <> ''
    )"""


@query("export_chunks", f"""
    WITH RECURSIVE {EXPORTED} SELECT doc_id, chunk_index::BIGINT AS chunk_index, chunk FROM pieces""")
def export_chunks(spark, folder):
    from lorebase.functions.chunking import export_chunks as cut

    pieces = table(spark, folder, "documents").select("doc_id", F.posexplode(cut(F.col("text"))).alias("p", "chunk"))
    return pieces.select("doc_id", (F.col("p") + 1).cast("bigint").alias("chunk_index"), "chunk")


@query("entry_drafts", f"""
    WITH RECURSIVE {EXPORTED},
    totals AS (SELECT doc_id, max(chunk_index) AS chunk_total FROM pieces GROUP BY 1),
    drafts AS (SELECT doc_id, chunk_index, chunk_total, chunk, hash, stem,
        '2026-06-11-' || stem || CASE WHEN chunk_total > 1 THEN '-part-' || lpad(chunk_index::VARCHAR, 3, '0') ELSE '' END AS wanted
        FROM pieces JOIN totals USING (doc_id) JOIN files USING (doc_id)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY doc_id, chunk_index) AS clash FROM drafts)
    SELECT CASE WHEN clash = 1 THEN wanted ELSE wanted || '-' || clash END AS entry_id,
        stem || CASE WHEN chunk_total > 1 THEN ' part ' || chunk_index || '/' || chunk_total ELSE '' END AS title,
        chunk_index::BIGINT AS chunk_index, chunk_total::BIGINT AS chunk_total, substr({compact('chunk')}, 1, 180) AS preview,
        ('2026-06-11-' || stem || '-' || hash || '.txt') AS archive FROM numbered""")
def entry_drafts(spark, folder):
    docs = table(spark, folder, "documents")
    name = F.concat(F.col("lang"), F.lit("-"), F.col("source"), F.lit(".txt"))
    digest16 = T.sha256(F.col("text"), rules.ARCHIVE_HASH_HEX)
    files = docs.select(
        F.col("doc_id").alias("ordinal"), name.alias("name"), digest16.alias("source_hash"), "text",
        indexing.archive_name(name, digest16, "2026-06-11").alias("archived"),
    )
    drafts = indexing.export_entries(files, "2026-06-11")
    return drafts.select(
        "entry_id", "title", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("chunk_total").cast("bigint").alias("chunk_total"), "preview",
        F.regexp_extract("entry", "source_refs: \\[\"([^\"]*)\"", 1).alias("archive"),
    )


@query("entry_constraints", f"""
    SELECT doc_id, concat_ws(',', CASE WHEN NOT regexp_matches(source || '-' || lang, {quoted(rules.ENTRY_ID_PATTERN)}) THEN 'id' END,
        CASE WHEN {compact('substr(text, 1, 40)')} = '' THEN 'title' END,
        CASE WHEN lang NOT IN ({', '.join(quoted(t) for t in rules.ENTRY_TYPES)}) THEN 'type' END,
        CASE WHEN quality IS NULL OR (CASE quality WHEN 1 THEN 'active' WHEN 0 THEN 'draft' END) NOT IN ('draft', 'active', 'superseded', 'archived') THEN 'status' END,
        CASE WHEN toxic IS NULL THEN 'confidence' END) AS violations
    FROM documents LEFT JOIN labels USING (doc_id)""")
def entry_constraints(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    entries = docs.join(labels, "doc_id", "left").select(
        "doc_id", F.concat_ws("-", "source", "lang").alias("id"), T.compact(F.substring("text", 1, 40)).alias("title"),
        F.col("lang").alias("type"), F.when(F.col("quality") == 1, "active").when(F.col("quality") == 0, "draft").alias("status"),
        F.lit("2026-06-11").alias("date"), F.array("source").alias("source_refs"),
        F.when(F.col("toxic").isNotNull(), "low").alias("confidence"), F.col("lang").alias("summary"),
    )
    return digest.entry_violations(entries, require_confidence=True).select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("file_classify", r"""
    SELECT page_id, CASE WHEN regexp_matches(path, '[^.]\.(html)$') THEN 'text' WHEN mime = 'application/pdf' THEN 'pdf_text'
        WHEN starts_with(mime, 'image/') THEN 'image_metadata_only' ELSE 'file_metadata_only' END AS classification,
        CASE WHEN regexp_matches(path, '[^.]\.(html)$') THEN 'html' ELSE 'none' END AS extractor
    FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
        CASE WHEN contains(url, '/de/') THEN 'application/pdf' WHEN contains(url, '/fr/') THEN 'image/png' ELSE '' END AS mime FROM pages)""")
def file_classify(spark, folder):
    from lorebase.sources.adapters import url_path

    mime = F.when(F.contains("url", F.lit("/de/")), "application/pdf").when(F.contains("url", F.lit("/fr/")), "image/png").otherwise("")
    files = table(spark, folder, "pages").select("page_id", url_path(F.col("url")).alias("path"), mime.alias("mime"))
    # a .html page is text whatever its declared type, so the declared type only counts without a suffix
    declared = F.when(T.suffix(F.col("path")) == ".html", "").otherwise(F.col("mime"))
    return files.select(
        "page_id", V.file_class(F.col("path"), declared).alias("classification"),
        F.coalesce(V.extractor(F.col("path")), F.lit("none")).alias("extractor"),
    )


# --- chat messages ------------------------------------------------------------------------------------------------
_MESSAGE = """CASE role WHEN 'user' THEN '/ask ' || text WHEN 'system' THEN 'Remember ' || text
    ELSE CASE WHEN turn % 4 = 3 THEN '开始记' ELSE text END END"""


def chat_messages(spark, folder):
    text = (
        F.when(F.col("role") == "user", F.concat(F.lit("/ask "), F.col("text")))
        .when(F.col("role") == "system", F.concat(F.lit("Remember "), F.col("text")))
        .otherwise(F.when(F.col("turn") % 4 == 3, "开始记").otherwise(F.col("text")))
    )
    return table(spark, folder, "conversations").withColumn("message", text)


@query("command_parse", f"""
    SELECT conv_id, turn, CASE WHEN m = '开始记' THEN 'record_on' WHEN starts_with(lower(m), '/ask') THEN 'ask'
        WHEN regexp_matches(m, '(?i)^remember\\s+[^\\n]+$') AND NOT contains({strip('m')}, chr(10)) THEN 'note' ELSE 'agent' END AS command,
        CASE WHEN m = '开始记' THEN '' WHEN starts_with(lower(m), '/ask') THEN {strip('substr(m, 5)')}
        WHEN regexp_matches(m, '(?i)^remember\\s+[^\\n]+$') AND NOT contains({strip('m')}, chr(10)) THEN {strip("substr(m, 10)")} ELSE {strip('m')} END AS body
    FROM (SELECT conv_id, turn, {strip(_MESSAGE)} AS m FROM conversations)""")
def command_parse(spark, folder):
    messages = chat_messages(spark, folder)
    return messages.select("conv_id", "turn", I.parse_command(F.col("message")).alias("c")).select("conv_id", "turn", "c.*")


_BARE = f"regexp_replace({fold(strip('text'))}, {quoted(rules.INTENT_PUNCTUATION)}, '', 'g')"


@query("intent_flags", f"""
    SELECT conv_id, turn, length(b) > 0 AND (length(b) <= 8 OR (length(b) <= 28 AND {_any('b', rules.FOLLOWUP_MARKERS)})
        OR regexp_matches(text, {quoted(rules.FOLLOWUP_START)})) AS follow_up,
        {_any(fold('text'), rules.LAB_QUERY_MARKERS)} AS lab_query, {_any(fold('text'), rules.FILE_REQUEST_WORDS)} AS file_request,
        CASE WHEN {_any(fold('text'), rules.FILE_REQUEST_WORDS)} THEN 'find_file' ELSE 'query_notebook' END AS action
    FROM (SELECT conv_id, turn, text, {_BARE} AS b FROM conversations)""")
def intent_flags(spark, folder):
    text = F.col("text")
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", I.is_follow_up(text).alias("follow_up"), I.is_lab_query(text).alias("lab_query"),
        I.is_file_request(text).alias("file_request"), I.route(text).alias("action"),
    )
