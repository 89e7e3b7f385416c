"""Distilled pages as sources, page evidence, record gates and day content over inputs derived so that every branch fires."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lorebase import rules
from lorebase.catalogue.registry import ESC, compact, fold, query, quoted, redact
from lorebase.functions import intent as I
from lorebase.functions import text as T
from lorebase.operators import messages, noise, render, search, topics
from lorebase.sources import distilled
from lorebase.sources.adapters import table

_LISTS = [name for name, _ in distilled.LISTS]
_SUMMARY = "CASE WHEN doc_id % 4 <> 0 THEN 'About ' || lang || ' token=abc' END"
_FACTS = "CASE WHEN doc_id % 3 = 0 THEN [] WHEN doc_id % 3 = 1 THEN ['one ' || doc_id, 'two'] END"


def distilled_pages(spark, folder):
    """A distilled page per document: some without a summary, facts or title."""
    docs = table(spark, folder, "documents")
    facts = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.array(F.concat(F.lit("one "), F.col("doc_id")), F.lit("two")))
    summary = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("About "), "lang", F.lit(" token=abc")))
    fields = {"one_sentence_summary": summary, "what_happened": F.array("source"), "important_facts": facts, "tags": F.array("lang", "source")}
    none = F.lit(None).cast("array<string>")
    return docs.select("doc_id", F.col("lang").alias("section"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Page "), "doc_id")).otherwise("").alias("title"),
                       F.concat(F.lit("h/"), "doc_id", F.lit(".html")).alias("html"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("sha"), "doc_id")).alias("source_sha256"),
                       F.lit("2026-01-01").alias("created"), F.lit("").alias("updated"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a.pdf"), F.lit("b.png"))).alias("attachments"),
                       F.struct(fields["one_sentence_summary"].alias("one_sentence_summary"), *[fields.get(n, none).alias(n) for n in _LISTS]).alias("distilled"), "text")


_DISTILLED_TEXT = f"""'Section: ' || lang || chr(10) || chr(10) || 'Title: ' || CASE WHEN doc_id % 5 <> 0 THEN 'Page ' || doc_id ELSE '' END || chr(10) || chr(10) || 'Summary: ' || coalesce({_SUMMARY}, '')
    || chr(10) || chr(10) || 'What happened:' || chr(10) || source || chr(10) || chr(10) || 'Important facts:' || chr(10) || coalesce(array_to_string({_FACTS}, chr(10)), '')
    || chr(10) || chr(10) || 'Decisions or conclusions:' || chr(10) || chr(10) || chr(10) || 'Open questions or next steps:' || chr(10) || chr(10) || chr(10) || 'People, organizations, equipment:' || chr(10)
    || chr(10) || chr(10) || 'Tags: ' || lang || chr(10) || source || chr(10) || chr(10) || 'Attachments: ' || CASE WHEN doc_id % 2 = 0 THEN 'a.pdf' || chr(10) || 'b.png' ELSE '' END"""


@query("distillation_sources", f"""
    WITH d AS (SELECT *, lang || '/' || CASE WHEN doc_id % 5 <> 0 THEN 'Page ' || doc_id ELSE 'Untitled' END || '/' || CASE WHEN doc_id % 2 = 0 THEN 'sha' || doc_id ELSE 'h/' || doc_id || '.html' END AS base FROM documents)
    SELECT 'distilled:' || substr(sha256(base), 1, 16) AS source_id, 'distilled_page' AS source_type, CASE WHEN doc_id % 5 <> 0 THEN 'Page ' || doc_id ELSE 'Untitled' END AS title, '2026-01-01' AS date,
        {redact(_DISTILLED_TEXT)} AS text, coalesce(array_to_string({_FACTS}, chr(10)), '') AS facts FROM d
    UNION ALL SELECT 'html:' || substr(sha256('h/' || doc_id || '.html'), 1, 16), 'source_html', CASE WHEN doc_id % 5 <> 0 THEN 'Page ' || doc_id ELSE 'Untitled' END, '2026-01-01', {redact("'Raw ' || doc_id || ' secret: abc'")}, NULL
    FROM d WHERE doc_id % 3 = 0""")
def distillation_sources(spark, folder):
    """Every third page still has its HTML; one in six of those files is blank or of no page."""
    pages = distilled_pages(spark, folder)
    files = pages.where("doc_id % 3 = 0").select(F.col("html").alias("rel"), F.concat(F.lit("<p>Raw "), "doc_id", F.lit(" secret: abc</p>")).alias("text"))
    extra = pages.where("doc_id % 3 = 1").select(F.when(F.col("doc_id") % 2 == 0, F.col("html")).otherwise(F.concat(F.lit("no/"), "html")).alias("rel"), F.lit("<p> </p>").alias("text"))
    out = distilled.distillation_sources(pages, files.unionByName(extra))
    return out.select("source_id", "source_type", "title", "date", "text", F.try_element_at("metadata", F.lit("important_facts")).alias("facts"))


@query("evidence_of_distilled", f"""
    SELECT doc_id, {redact(f"coalesce({_SUMMARY}, '')")} AS summary, source AS what_happened, lang || '|' || source AS tags, CASE WHEN doc_id % 2 = 0 THEN 'a.pdf|b.png' ELSE '' END AS attachments,
        CASE WHEN doc_id % 3 = 1 THEN 'one ' || doc_id || '|two' ELSE substr({compact(redact(_DISTILLED_TEXT))}, 1, 1200) END AS important_facts,
        CASE WHEN doc_id % 2 = 0 THEN 'sha' || doc_id ELSE '' END AS source_sha256 FROM documents""")
def evidence_of_distilled(spark, folder):
    """Evidence of chunks whose page was distilled: its fields, and the text's own beginning where it has no facts."""
    sources = distilled.distillation_sources(distilled_pages(spark, folder))
    chunks = sources.withColumns({"chunk_id": F.col("path"), **{c: F.lit(1.0) for c in ("score", "semantic_score", "lexical_score")}})
    joined = [F.array_join(c, "|").alias(c) for c in ("what_happened", "tags", "attachments", "important_facts")]
    number = F.regexp_extract("id", r"(\d+)", 1).cast("bigint").alias("doc_id")
    return search.evidence(chunks).select(number, "summary", "source_sha256", *joined)


@query("page_evidence", f"""
    WITH numbered AS (SELECT *, row_number() OVER (ORDER BY lang, doc_id) AS id FROM documents),
    picked AS (SELECT id, min(position) AS position FROM (SELECT turn AS position, try_cast(CASE WHEN turn % 4 = 3 THEN 'page ' || conv_id ELSE (conv_id * 7 - 20)::VARCHAR END AS BIGINT) AS id
        FROM conversations WHERE turn < 4) WHERE id >= 1 GROUP BY id)
    SELECT position, id, 100 - id AS score, lang AS section, CASE WHEN doc_id % 5 <> 0 THEN 'Page ' || doc_id ELSE '' END AS title, coalesce({_SUMMARY}, '') AS summary,
        coalesce(array_to_string({_FACTS}, '|'), '') AS important_facts FROM numbered JOIN picked USING (id)""")
def page_evidence(spark, folder):
    """Pages picked by number: some picks are no number, out of range or repeated."""
    picks = table(spark, folder, "conversations").where("turn < 4").select(F.col("turn").alias("position"), F.when(F.col("turn") % 4 == 3, F.concat(F.lit("page "), "conv_id")).otherwise(
        (F.col("conv_id") * 7 - 20).cast("string")).alias("id"))
    found = search.page_evidence(distilled_pages(spark, folder), picks, ["section", "doc_id"])
    return found.select("position", "id", "score", "section", "title", "summary", F.array_join("important_facts", "|").alias("important_facts"))


_RECORD_TEXT = """concat_ws(chr(10), 'a' || conv_id, CASE WHEN turn % 2 = 0 THEN 'Quote ' || turn END, nullif(text, ''), 'note', nullif(role, 'user'),
    CASE WHEN turn % 3 = 0 THEN 'f.pdf' || chr(10) || 'text/x' || chr(10) || 'g' END)"""


@query("record_gate", f"""
    WITH r AS (SELECT conv_id, turn, {_RECORD_TEXT} AS search_text FROM (SELECT conv_id, turn, role, text || CASE turn % 5 WHEN 1 THEN ' your otp' WHEN 2 THEN ' unsubscribe' WHEN 3 THEN ' discount' ELSE '' END AS text FROM conversations))
    SELECT conv_id, turn, search_text, CASE WHEN regexp_matches(f, {quoted(rules.OTP_PATTERNS[0])}) OR regexp_matches(f, {quoted(rules.OTP_PATTERNS[1])}) OR regexp_matches(f, {quoted(rules.OTP_PATTERNS[2])}) THEN 'verification_or_login_code'
        WHEN (regexp_matches(f, {quoted(rules.AD_PATTERNS[0])}) OR regexp_matches(f, {quoted(rules.AD_PATTERNS[1])})) AND NOT ({' OR '.join(f"contains(f, {quoted(h)})" for h in rules.DIGEST_HINTS)}) THEN 'advertising_or_newsletter' ELSE '' END AS reason
    FROM (SELECT *, {fold('search_text')} AS f FROM r)""")
def record_gate(spark, folder):
    """The gate judges a record by all its fields: a hint in the subject or in a file's name keeps an advertisement."""
    more = F.element_at(F.array(*[F.lit(x) for x in ("", " your otp", " unsubscribe", " discount", "")]), (F.col("turn") % 5 + 1).cast("int"))
    files = F.when(F.col("turn") % 3 == 0, F.expr("array(named_struct('filename', 'f.pdf', 'name', '', 'mime_type', 'text/x', 'text_preview', cast(null as string)), named_struct('filename', cast(null as string), 'name', 'g', 'mime_type', '', 'text_preview', ''))"))
    records = table(spark, folder, "conversations").select("conv_id", "turn", F.concat(F.lit("a"), "conv_id").alias("sender"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Quote "), "turn")).alias("subject"),
                                                           F.concat("text", more).alias("text"), F.lit("note").alias("kind"), F.nullif("role", F.lit("user")).alias("person"), files.alias("files"))
    judged = records.withColumn("search_text", noise.record_text(records)).withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    return noise.gate_records(judged, None, "id", "search_text").select("conv_id", "turn", "search_text", "reason")


_DAY, _NOTE = "2026-06-12", "Supplement distilled from email records archived on 2026-06-12."


@query("day_content", f"""
    WITH r AS (SELECT doc_id, source, text, doc_id % 7 AS g FROM documents),
    held AS (SELECT * FROM r WHERE g < 5), rest AS (SELECT * FROM r WHERE g >= 5),
    pages AS (SELECT CASE g WHEN 0 THEN 'en' WHEN 3 THEN 'en' ELSE 'Unsorted Communication Records' END AS section, CASE WHEN g = 2 THEN 'email supplement' WHEN g = 4 THEN 'Topic 1' ELSE 'Topic ' || g END || ' Supplement {_DAY} [email]' AS title,
        count(*) AS records, CASE WHEN g % 2 = 0 THEN 'Summary ' || g ELSE '{_DAY} email supplemental records.' END AS summary, CASE WHEN g % 2 = 0 THEN 'mine|email' ELSE 'email' END || '|communication-supplement|{_DAY}' AS tags,
        '{_NOTE}' AS notes, 'x.pdf|y.png' AS assets, '' AS facts, g FROM held WHERE g <> 1 GROUP BY g)
    SELECT section, title, records, summary, tags, notes, assets, facts FROM pages
    UNION ALL SELECT 'Unsorted Communication Records', 'Email supplement {_DAY} Supplement {_DAY} [email]', (SELECT count(*) FROM rest), '{_DAY} email supplemental records.', 'email|communication-supplement|{_DAY}', '{_NOTE}', 'x.pdf|y.png',
        (SELECT string_agg(source || ': ' || substr(text, 1, 500), '|' ORDER BY doc_id) FROM (SELECT * FROM rest ORDER BY doc_id LIMIT 30)) WHERE EXISTS (FROM rest)""")
def day_content(spark, folder):
    """Groups with an unknown section, no title, no summary or tags of their own; one title twice in a section; one group without a record."""
    docs = table(spark, folder, "documents")
    records = docs.select(F.col("doc_id").cast("string").alias("record_id"), F.col("doc_id").alias("ordinal"), F.col("source").alias("label"), "text")
    group = F.when(F.col("doc_id") % 7 == 1, 4).otherwise(F.col("doc_id") % 7)
    members = docs.where("doc_id % 7 < 5").select(F.concat(F.lit("g"), group).alias("group_id"), F.col("doc_id").cast("string").alias("record_id"))
    members = members.where("group_id <> 'g4' OR CAST(record_id AS BIGINT) % 7 = 4").unionByName(docs.where("doc_id % 7 = 1").select(F.lit("g1").alias("group_id"), F.col("doc_id").cast("string").alias("record_id")))
    some = F.col("id") % 2 == 0
    lists = [F.when(some & F.lit(n == "tags"), F.array(F.lit("mine"), F.lit("email"))).alias(n) for n in topics.LISTS]
    groups = spark.range(7).select(
        F.concat(F.lit("g"), "id").alias("group_id"), F.when(F.col("id").isin(0, 3), " en ").when(F.col("id") == 2, "").otherwise("Nope").alias("section"),
        F.when(F.col("id") == 2, F.lit(None)).when(F.col("id") == 4, "Topic 1").otherwise(F.concat(F.lit("Topic "), "id")).alias("topic_title"),
        F.when(some, F.struct(F.concat(F.lit("Summary "), "id").alias("one_sentence_summary"), *lists)).alias("distilled"))
    found, held = topics.normalised_groups(groups, members, records, docs.select(F.col("lang").alias("section")), "email", _DAY, ["x.pdf", "y.png"])
    pages = topics.content_pages(found, held, "email", _DAY, "d.html", "now")
    joined = [F.array_join(f"distilled.{c}", "|").alias(a) for c, a in (("tags", "tags"), ("confidence_notes", "notes"), ("important_assets_or_attachments", "assets"), ("important_facts", "facts"))]
    return pages.select("section", "title", "records", F.col("distilled.one_sentence_summary").alias("summary"), *joined)


@query("section_upkeep", f"""
    SELECT section, page_count, created FROM (SELECT lang AS section, count(*) AS page_count, false AS created FROM documents GROUP BY 1
        UNION ALL SELECT DISTINCT source, 0, true FROM documents WHERE source IS NOT NULL)""")
def section_upkeep(spark, folder):
    """Sections made on demand; a channel's own section goes when its last page has gone."""
    docs = table(spark, folder, "documents")
    channel = spark.createDataFrame([(rules.CHANNEL_SECTIONS[0], 0), (rules.CHANNEL_SECTIONS[1], 0)], "section STRING, page_count LONG")
    sections = docs.groupBy(F.col("lang").alias("section")).agg(F.count("*").alias("page_count")).unionByName(channel)
    kept = topics.prune_empty_sections(sections, docs.select(F.col("lang").alias("section")))
    return topics.ensure_sections(kept, docs.select(F.col("source").alias("section")).unionByName(docs.select(F.col("lang").alias("section"))))


@query("known_chats", """
    SELECT user_id::VARCHAR AS chat_id, min(event_type) AS chat_type FROM events WHERE user_id % 3 = 0 GROUP BY 1
    UNION ALL SELECT DISTINCT user_id::VARCHAR, 'group' FROM events WHERE user_id % 3 <> 0 AND user_id % 5 <> 0""")
def known_chats(spark, folder):
    """A third of the chats is listed by the service; configured ones may repeat those, each other, or be blank."""
    events = table(spark, folder, "events")
    visible = events.where("user_id % 3 = 0").groupBy(F.col("user_id").cast("string").alias("chat_id")).agg(F.min("event_type").alias("chat_type"))
    return messages.known_chats(visible, events.select(F.when(F.col("user_id") % 5 == 0, "").otherwise(F.col("user_id").cast("string")).alias("chat_id")))


_ALIASED = "cavity finesse"
_ALIAS_TERMS = ["cavity", "finesse", "optical", "out-of-vacuum", "test", "mirror"]
_CJK_TERMS = ["精细", "细度", "精细度"]
_TITLE = "CASE doc_id % 6 WHEN 0 THEN 'Optical test' WHEN 1 THEN 'Mirror 精细度' WHEN 2 THEN 'Out-of-vacuum' ELSE 'Page' END"


@query("page_alias_rank", f"""
    WITH p AS (SELECT doc_id, {_TITLE} AS title FROM documents),
    s AS (SELECT doc_id, title, round({' + '.join(f"(CASE WHEN contains({fold('title')}, {quoted(t)}) THEN 5.0 ELSE 0 END)" for t in [*_ALIAS_TERMS, *_CJK_TERMS])}, 4)::DOUBLE AS score FROM p)
    SELECT doc_id, score, substr(title, 1, 360) AS snippet FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 5""")
def page_alias_rank(spark, folder):
    """The page aliases bring terms that the question does not have."""
    pages = table(spark, folder, "documents").select("doc_id", F.expr(_TITLE).alias("title"))
    hits = search.rank_pages(pages, _ALIASED, "doc_id", {"title": T.casefold(F.col("title"))}, alias_rules=rules.PAGE_ALIASES)
    return search.with_page_snippet(hits, F.col("title"), _ALIASED, alias_rules=rules.PAGE_ALIASES).select("doc_id", "score", "snippet")


_SAID = {0: "/ask  what?", 1: "/start", 2: "开始记", 3: "/note keep this", 4: "/STATUS", 5: "谢谢！", 6: "查 DDS", 7: "记：温度 20"}
_PARSED = {0: ("ask", "what?"), 1: ("agent", "/start"), 2: ("agent", "开始记"), 3: ("note", "keep this"), 4: ("status", ""), 5: ("chat", "谢谢！"), 6: ("ask", "DDS"), 7: ("note", "温度 20")}


@query("command_parse_polled", f"""
    SELECT conv_id, turn, {reduce(lambda a, k: a + f" WHEN {k} THEN {quoted(_PARSED[k][0])}", _PARSED, "CASE (conv_id + turn) % 8")} END AS command,
        {reduce(lambda a, k: a + f" WHEN {k} THEN {quoted(_PARSED[k][1])}", _PARSED, "CASE (conv_id + turn) % 8")} END AS body FROM conversations""")
def command_parse_polled(spark, folder):
    """The polled channel's grammar: no modes, notes before casual talk, an unknown command is talk."""
    said = F.element_at(F.array(*[F.lit(_SAID[k]) for k in range(8)]), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    return table(spark, folder, "conversations").select("conv_id", "turn", I.parse_command(said, "lark").alias("c")).select("conv_id", "turn", "c.*")


# --- rendered pages -------------------------------------------------------------------------------------------------------
_END = (1 << 62) - 1


@query("manifest_page", f"""
    WITH p AS (SELECT lang AS section, doc_id, '<' || source || ' & "' || doc_id || '">' AS title, substr(text, 1, 60) AS preview FROM documents)
    SELECT section, doc_id AS at, 1 AS part, '<tr><td>' || doc_id || '</td><td><a href="h/' || doc_id || '.html">' || {ESC.format('title')} || '</a></td><td></td><td>' || {ESC.format('preview')} || '</td></tr>' AS html FROM p
    UNION ALL SELECT section, -1, 0, '<section><h2>' || section || ' (' || count(*) || ')</h2><table>' FROM p GROUP BY section
    UNION ALL SELECT section, {_END}, 2, '</table></section>' FROM p GROUP BY section""")
def manifest_page(spark, folder):
    docs = table(spark, folder, "documents")
    pages = docs.select(F.col("lang").alias("section"), F.col("doc_id").alias("order"), F.concat(F.lit("<"), "source", F.lit(' & "'), "doc_id", F.lit('">')).alias("title"),
                        F.concat(F.lit("h/"), "doc_id", F.lit(".html")).alias("html"), F.lit(None).cast("string").alias("updated"), F.substring("text", 1, 60).alias("text_preview"))
    return render.manifest_fragments(pages)


@query("digest_page", f"""
    SELECT lang AS section, doc_id AS at, 1 AS part, '<article><h3>' || CASE WHEN doc_id % 5 <> 0 THEN 'Page ' || doc_id ELSE '' END || '</h3><p>' || coalesce({_SUMMARY}, '') || '</p>'
        || CASE WHEN doc_id % 3 = 1 THEN '<h4>Important facts</h4><ul><li>one ' || doc_id || '</li><li>two</li></ul>' ELSE '' END || '<h4>Tags</h4><ul><li>' || lang || '</li><li>' || source || '</li></ul>'
        || '<p><a href="h/' || doc_id || '.html">source</a></p></article>' AS html FROM documents
    UNION ALL SELECT lang, -1, 0, '<section><h2>' || lang || '</h2><p>' || count(*) || ' pages</p>' FROM documents GROUP BY lang
    UNION ALL SELECT lang, {_END}, 2, '</section>' FROM documents GROUP BY lang""")
def digest_page(spark, folder):
    pages = distilled_pages(spark, folder).select("doc_id", "section", "title", "html", F.col("distilled.one_sentence_summary").alias("summary"), "distilled.important_facts", "distilled.tags")
    return render.digest_fragments(pages, "doc_id", [("important_facts", "Important facts"), ("tags", "Tags")])


@query("question_page", f"""
    SELECT 1 AS section, doc_id AS at, 1 AS part, '<article><h3>' || source || '</h3><p>' || lang || ' | score 0.500</p><p>' || {ESC.format('substr(text, 1, 80)')} || '</p><blockquote>' || {ESC.format('substr(text, 1, 300)')}
        || '</blockquote></article>' AS html FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 5)
    UNION ALL SELECT 1, -1, 0, '<!DOCTYPE html><html><body><h1>Is x &lt; y?</h1><p>yes &amp; no</p>' UNION ALL SELECT 1, {_END}, 2, '</body></html>'""")
def question_page(spark, folder):
    first = table(spark, folder, "documents").orderBy("doc_id").limit(5)
    evidence = first.select("doc_id", F.col("source").alias("title"), F.col("lang").alias("section"), F.lit(0.5).alias("score"), F.substring("text", 1, 80).alias("summary"), F.substring("text", 1, 300).alias("source_snippet"))
    return render.question_fragments(evidence, "Is x < y?", "yes & no", "doc_id")
