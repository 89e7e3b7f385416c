"""Queries over inputs derived from the tables so that every branch of an operator is hit.

Each input is one expression, written once and put into both engines, e.g. the text of a turn with a credential after it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.catalogue.registry import any_of, fold, matches, query, redact
from lorebase.functions import html as H
from lorebase.functions import intent as I
from lorebase.functions import text as T
from lorebase.operators import publish
from lorebase.operators.grouping import TEXTS_PER_BLOCK
from lorebase.plans.versions import VersionedTable
from lorebase.session import shared_folder
from lorebase.sources import chat, files, mail
from lorebase.sources.adapters import host, table, url_path
from lorebase.sources.binaries import decode_text

_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"

# --- credentials ----------------------------------------------------------------------------------------------------
_SAID = """text || CASE (conv_id + turn) % 5 WHEN 0 THEN ' bot12:abc_d cli_a1b2c3 ' WHEN 1 THEN ' 1234567:abcdefghijklmnopqrstu'
    WHEN 2 THEN ' app_secret: abcdefgh12 sk-abc' WHEN 3 THEN ' encrypt-key=ABCDEFGH99' ELSE '' END"""


@query("redact_chat_credentials", f"""
    WITH t AS (SELECT conv_id, turn, text AS plain, {_SAID} AS text FROM conversations)
    SELECT conv_id, turn, pushed, polled, pushed <> text AS push_hit, polled <> text AS poll_hit FROM (
        SELECT *, {redact('text', rules.PUSH_CHAT_REDACTION)} AS pushed, {redact('text', rules.POLLED_CHAT_REDACTION)} AS polled FROM t)""")
def redact_chat_credentials(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.expr(_SAID).alias("text"))
    both = turns.select("*", T.redact(F.col("text"), rules.PUSH_CHAT_REDACTION).alias("pushed"), T.redact(F.col("text"), rules.POLLED_CHAT_REDACTION).alias("polled"))
    return both.select("conv_id", "turn", "pushed", "polled", (F.col("pushed") != F.col("text")).alias("push_hit"), (F.col("polled") != F.col("text")).alias("poll_hit"))


_FILE = """text || CASE doc_id % 6 WHEN 0 THEN ' ghp_abcdefghij0123456789' WHEN 1 THEN ' -----BEGIN RSA PRIVATE KEY-----'
    WHEN 2 THEN ' client_secret = "abcdefgh1"' ELSE CASE WHEN doc_id % 200 = 3 THEN repeat('0123456789abcdef', 700000) ELSE '' END END"""


@query("publish_gate_hits", f"""
    WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'notes/token_cache.bin' ELSE 'notes/' || doc_id END AS path, {_FILE} AS text FROM documents)
    SELECT doc_id, {matches('text', rules.PUBLISH_SECRET_PATTERNS)} AS secret, CASE WHEN contains(path, 'token_cache') THEN 'private path'
        WHEN strlen(text) > {rules.PUBLISH_MAX_BYTES} THEN 'file exceeds the size limit'
        WHEN {matches('text', rules.PUBLISH_SECRET_PATTERNS)} THEN 'possible embedded credential' ELSE '' END AS problem FROM d""")
def publish_gate_hits(spark, folder):
    path = F.expr("CASE WHEN doc_id % 7 = 0 THEN 'notes/token_cache.bin' ELSE concat('notes/', doc_id) END")
    docs = table(spark, folder, "documents").select("doc_id", path.alias("path"), F.expr(_FILE).alias("text"))
    gated = publish.publish_verdict(docs.select("*", F.octet_length("text").alias("size"), F.lit(False).alias("binary"), publish.has_secret(F.col("text")).alias("secret")))
    return gated.select("doc_id", "secret", "problem")


# --- pages ------------------------------------------------------------------------------------------------------------
_WITH_FILES = """replace(html, '</body>', '<img src="img/' || page_id || '.png"><embed src="doc.pdf">'
    || CASE WHEN page_id % 3 = 0 THEN '<img src="doc.pdf"><img alt="none">' ELSE '<img src="b.png">' END || '</body>')"""


@query("page_attachments_hits", """
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'img/' || page_id || '.png,doc.pdf' ELSE 'img/' || page_id || '.png,doc.pdf,b.png' END AS attachments
    FROM pages WHERE contains(html, '</body>')""")
def page_attachments_hits(spark, folder):
    pages = table(spark, folder, "pages").where(F.contains(F.col("html"), F.lit("</body>"))).select("page_id", F.expr(_WITH_FILES).alias("html"))
    return pages.select("page_id", F.array_join(H.attachments(F.col("html")), ",").alias("attachments"))


@query("page_links_hits", f"""
    WITH p AS (SELECT page_id, {_HOST} AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)
    SELECT a.page_id, a.path AS href, min(b.page_id) AS target FROM p a JOIN p b ON a.host = b.host AND a.path = b.path WHERE a.path <> '' GROUP BY ALL""")
def page_links_hits(spark, folder):
    """Every page links to its own path, which resolves to the first page of the host with that path."""
    pages = table(spark, folder, "pages").select("page_id", host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    html = F.concat(F.lit('<p><a href="'), F.col("path"), F.lit('">self</a></p>'))
    links = pages.select("page_id", "host", F.explode(H.links(html)).alias("href"))
    targets = pages.groupBy("host", F.col("path").alias("href")).agg(F.min("page_id").alias("target"))
    return links.join(targets, ["host", "href"]).select("page_id", "href", "target")


# --- intents ------------------------------------------------------------------------------------------------------------
_ASKED = "text || CASE turn % 4 WHEN 0 THEN ' 说明书' WHEN 1 THEN ' 真空 参数' WHEN 2 THEN ' please send the DATASHEET' ELSE '' END"


@query("intent_hits", f"""
    SELECT conv_id, turn, {any_of(fold('text'), rules.LAB_QUERY_MARKERS)} AS lab_query, {any_of(fold('text'), rules.FILE_REQUEST_WORDS)} AS file_request,
        CASE WHEN {any_of(fold('text'), rules.FILE_REQUEST_WORDS)} THEN 'find_file' ELSE 'query_notebook' END AS action
    FROM (SELECT conv_id, turn, {_ASKED} AS text FROM conversations)""")
def intent_hits(spark, folder):
    text = F.col("text")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.expr(_ASKED).alias("text"))
    return turns.select("conv_id", "turn", I.is_lab_query(text).alias("lab_query"), I.is_file_request(text).alias("file_request"), I.route(text).alias("action"))


_NAME = "CASE p_partkey % 4 WHEN 0 THEN '***' WHEN 1 THEN '' WHEN 2 THEN '§§ ' || p_name ELSE repeat(p_name || '-', 9) END"


@query("slug_fallbacks", f"""
    SELECT p_partkey, CASE WHEN s = '' THEN 'imported-note' ELSE trim(substr(s, 1, 60), '-') END AS import_slug
    FROM (SELECT p_partkey, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM (SELECT p_partkey, {_NAME} AS name FROM part))""")
def slug_fallbacks(spark, folder):
    return table(spark, folder, "part").select("p_partkey", T.slug_import(F.expr(_NAME)).alias("import_slug"))


# --- sources --------------------------------------------------------------------------------------------------------------
_LINE = """CASE event_id % 5 WHEN 0 THEN '{"id": ' || event_id || ', "user": {"id": "' || user_id || '", "name": "u"}, "files": [{"path": "a"}]}'
    WHEN 1 THEN '{"id": "' || event_id || '", "user": {"id": "none"}, "files": "none"}' WHEN 2 THEN '{"id": ' || event_id || ', broken' WHEN 3 THEN '[1, 2]'
    ELSE '{"user": null, "id": ' || event_id || '.0}' END"""


@query("json_lines", """
    SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN user_id END AS user_id, CASE WHEN event_id % 5 = 0 THEN 'u' END AS name,
        CASE WHEN event_id % 5 = 0 THEN 1 END AS n_files FROM events WHERE event_id % 5 IN (0, 1, 4)""")
def json_lines(spark, folder):
    lines = table(spark, folder, "events").select(F.expr(_LINE).alias("value"))
    records = files.parse_json_lines(lines, "id BIGINT, user STRUCT<id: BIGINT, name: STRING>, files ARRAY<STRUCT<path: STRING>>")
    return records.select("id", F.col("user.id").alias("user_id"), F.col("user.name").alias("name"), F.when(F.col("files").isNotNull(), F.size("files")).alias("n_files"))


@query("entry_records", """
    SELECT 'e/' || doc_id || '.md' AS path, 'entry-' || doc_id AS id, 'T: ' || source AS title, lang || '|' || source AS tags, CASE WHEN doc_id % 3 = 0 THEN 'True' ELSE '' END AS status,
        'Head Body ' || doc_id AS body_text, CASE WHEN doc_id % 2 = 0 THEN 'entry-' || (doc_id - 1) || '|old' ELSE '' END AS supersedes, 'entry-' || (doc_id + 1) AS superseded_by FROM documents""")
def entry_records(spark, folder):
    text = F.expr("""'---\n# note: none\nid: wrong\nid: "entry-' || doc_id || '"\ntitle: T: ' || source || '\ntags: [' || lang || ", '" || source || "']" || CASE WHEN doc_id % 3 = 0 THEN '\nstatus: TRUE' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '\nsupersedes: [entry-' || (doc_id - 1) || ', "old"]' ELSE '' END || '\nsuperseded_by: entry-' || (doc_id + 1) || '\nprojects: []\n---\n## Head\n\nBody   ' || doc_id""")
    entries = files.parse_entries(table(spark, folder, "documents").select(F.concat(F.lit("e/"), F.col("doc_id"), F.lit(".md")).alias("path"), text.alias("text")))
    return entries.select("path", "id", "title", F.array_join("tags", "|").alias("tags"), "status", "body_text", F.array_join("supersedes", "|").alias("supersedes"), "superseded_by")


_SUBJECT = "CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'password: hunter2 quote ' || doc_id END"


# Every fifth mail carries files: a note, a picture and a blank one; every seventh is an advertisement.
_MAILS = f"""(SELECT doc_id, {_SUBJECT} AS subject, text || CASE WHEN doc_id % 7 = 0 THEN ' newsletter' ELSE ' token = abcdef' END AS body FROM documents)"""
_MAIL_TEXT = """'Source: email' || chr(10) || 'Date: 2026-06-11' || chr(10) || 'From: a@b.c' || chr(10) || 'Subject: ' || CASE WHEN subject = '' THEN '(no subject)' ELSE subject END
    || chr(10) || 'Preview:' || chr(10) || substr(body, 1, 2000) || chr(10) || 'Body:' || chr(10) || body || chr(10) || 'Attachments:' || chr(10)
    || CASE WHEN doc_id % 5 = 0 THEN 'file_name=n.txt; mime_type=text/plain; path=m/' || doc_id || '/n.txt' || chr(10) || 'file_name=p.png; path=m/p.png' || chr(10) || 'file_name=b.txt; path=x/b.txt' ELSE '' END"""
_MAIL_KEPT = f"NOT ({any_of(fold('text'), rules.INDEX_NOISE)})"


def _mails(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "text", F.expr(_SUBJECT).alias("subject"))
    body = F.concat("text", F.when(F.col("doc_id") % 7 == 0, F.lit(" newsletter")).otherwise(F.lit(" token = abcdef")))
    file = "named_struct('file_name', '{}', 'path', {}, 'mime_type', '{}', 'size', 1L, 'sha256', '', 'classification', '', 'text_preview', '', 'text_extract', {})"
    files_ = F.expr("array(" + ", ".join([file.format("n.txt", "'m/' || doc_id || '/n.txt'", "text/plain", "'note ' || text"), file.format("p.png", "'m/p.png'", "", "cast(null as string)"),
                                           file.format("", "'x/b.txt'", "", "' '")]) + ")")
    return rows.select(
        F.concat(F.lit("m/"), F.col("doc_id")).alias("path"), F.col("doc_id").cast("string").alias("message_id"), F.lit("2026-06-11").alias("date"), F.lit("a@b.c").alias("from"),
        "subject", body.alias("body"), F.substring(body, 1, 2000).alias("text_preview"), F.when(F.col("doc_id") % 5 == 0, files_).alias("attachments"))


@query("mail_sources", f"""
    SELECT title, author, {redact('text')} AS text FROM (
        SELECT {redact("CASE WHEN subject = '' THEN '(no subject)' ELSE subject END")} AS title, 'a@b.c' AS author, {_MAIL_TEXT} AS text FROM {_MAILS}) WHERE {_MAIL_KEPT}""")
def mail_sources(spark, folder):
    return mail.mail_sources(_mails(spark, folder), hints=()).select("title", "author", "text")


@query("mail_attachment_sources", f"""
    SELECT 'n.txt' AS title, 'm/' || doc_id || '/n.txt' AS path, {redact("'note ' || plain")} AS text FROM (
        SELECT m.doc_id, {_MAIL_TEXT.replace('doc_id', 'm.doc_id')} AS text, d.text AS plain FROM {_MAILS} m JOIN documents d ON d.doc_id = m.doc_id WHERE m.doc_id % 5 = 0) WHERE {_MAIL_KEPT}""")
def mail_attachment_sources(spark, folder):
    """Of the three files of a mail only the note has text; an advertisement's files are left out with it."""
    return mail.mail_attachment_sources(_mails(spark, folder), hints=()).select("title", "path", "text")


@query("chat_archive_sources", f"""
    SELECT title, author, {redact('text')} AS text FROM (
        SELECT 'Telegram 2026-06-11 p' || conv_id AS title, 'p' || conv_id AS author, 'Source: telegram' || chr(10) || 'Date: 2026-06-11' || chr(10) || 'Person: p' || conv_id || chr(10)
            || 'Kind: note' || chr(10) || 'Text:' || chr(10) || text || ' secret abc' || chr(10) || 'Files:' || chr(10) || 'file_name=f.pdf; path=x/f.pdf' AS text
        FROM conversations WHERE turn % 3 = 0)""")
def chat_archive_sources(spark, folder):
    """Of three turns one is a note, one of a kind that is no memory, one an advertisement."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    file = "array(named_struct('kind', '', 'path', 'x/f.pdf', 'file_name', '', 'mime_type', cast(null as string), 'file_size', 1L, 'classification', '', 'text_extract', '', 'html_preview', '', 'text_preview', ''))"
    records = turns.select(
        F.when(F.col("turn") % 3 == 1, "query").otherwise("note").alias("kind"), F.lit("").alias("created_at"), F.lit("2026-06-11").alias("day"),
        F.concat(F.lit("p"), F.col("conv_id")).alias("person"), F.lit("r").alias("record_path"), F.concat_ws(":", "conv_id", "turn").alias("message_id"), F.col("turn").alias("line"),
        F.when(F.col("turn") % 3 == 2, "newsletter").otherwise(F.concat("text", F.lit(" secret abc"))).alias("text"), F.expr(file).alias("files"))
    return chat.chat_sources(records, "telegram", hints=()).select("title", "author", "text")


@query("decoded_files", "SELECT doc_id, text FROM documents")
def decoded_files(spark, folder):
    """Every second file starts with a byte order mark."""
    mark = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    return table(spark, folder, "documents").select("doc_id", decode_text(F.concat(mark, F.encode("text", "UTF-8"))).alias("text"))


@query("manifest_rows", f"""
    SELECT {_HOST} AS section, url AS html, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) - 1 AS page_order FROM pages""")
def manifest_rows(spark, folder):
    """A nested manifest, a document per host and block of pages, back to one row per page."""
    pages = table(spark, folder, "pages").select("page_id", host(F.col("url")).alias("section"), "url")
    return files.flatten_manifest(_host_manifest(pages)).select("section", "html", "page_order")


def _host_manifest(pages, block_pages: int = TEXTS_PER_BLOCK):
    """Manifest documents of ``page_id, section, url``; only a count per block crosses the window of a whole host."""
    blocked = pages.withColumn("block", F.expr(f"page_id div {block_pages}"))
    counts = blocked.groupBy("section", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("section").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("section").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    nested = blocked.groupBy("section", "block").agg(F.sort_array(F.collect_list(F.struct("page_id", F.col("url").alias("html")))).alias("p"))
    nested = nested.join(offsets, F.col("section").eqNullSafe(F.col("s")) & F.col("block").eqNullSafe(F.col("b")))
    page = F.transform("p", lambda x, i: F.struct((i + F.col("offset")).cast("bigint").alias("page_order"), x["html"].alias("html")))
    return nested.select(F.array(F.struct("section", page.alias("pages"))).alias("sections"))


@query("page_tree_manifest", """
    WITH p AS (SELECT page_id, page_id // 40 AS n, 's' || (page_id // 40) || '/' || CASE WHEN page_id % 2 = 0 THEN 'P' ELSE 'p' END || page_id || '.html' AS html FROM pages)
    SELECT 's' || n AS section, row_number() OVER (PARTITION BY n ORDER BY CASE WHEN n % 2 = 0 THEN -page_id END, lower(html), html) AS "order", html, 'Page ' || page_id AS title
    FROM p WHERE n % 2 = 1 OR page_id % 3 <> 0""")
def page_tree_manifest(spark, folder):
    """A page tree of many sections. Even ones link two thirds of their pages, newest first, and the rest of their folder does
    not count; odd ones link nothing and list their folder by name, whatever its case."""
    n = F.expr("page_id div 40")
    rows = table(spark, folder, "pages").select("page_id", n.alias("n"), F.concat(F.lit("s"), n).alias("section"), "html")
    rel = F.concat("section", F.lit("/"), F.when(F.col("page_id") % 2 == 0, "P").otherwise("p"), "page_id", F.lit(".html"))
    pages = rows.select(rel.alias("rel"), F.concat(F.lit("<title>Page "), "page_id", F.lit("</title>"), "html").alias("text"))
    linked = F.when((F.col("n") % 2 == 0) & (F.col("page_id") % 3 != 0), F.struct((-F.col("page_id")).alias("at"), rel.alias("rel")))
    anchors = F.transform(F.sort_array("linked"), lambda x: F.concat(F.lit('<a href="./'), x["rel"], F.lit('">page</a>')))
    index = rows.groupBy("section").agg(F.collect_list(linked).alias("linked")).select(F.concat("section", F.lit(".html")).alias("rel"), F.array_join(anchors, "\n").alias("text"))
    manifest = files.tree_manifest(pages.unionByName(index))
    return manifest.select("section", F.col("order").cast("bigint").alias("order"), "html", "title")


@query("state_versions", f"""
    SELECT 1 AS version, doc_id, sha256(text) AS sha256 FROM documents WHERE lang IN ('en', 'fr', 'de')
    UNION ALL SELECT 2, doc_id, sha256({redact('text')}) FROM documents WHERE lang IN ('en', 'de', 'es')""")
def state_versions(spark, folder):
    """The state of two runs in a versioned table, the earlier one still readable; a third run that changes nothing adds none."""
    docs = table(spark, folder, "documents")
    path = f"{shared_folder(spark).rstrip('/')}/state-{uuid.uuid4().hex}"
    state = VersionedTable(spark, path, "doc_id LONG, sha256 STRING", ["doc_id"], buckets=16)
    first = state.write(docs.where(F.col("lang").isin("en", "fr", "de")).select("doc_id", T.sha256(F.col("text")).alias("sha256")))
    now = docs.where(F.col("lang").isin("en", "de", "es")).select("doc_id", T.sha256(T.redact(F.col("text"))).alias("sha256"))
    second = state.write(now, docs.where("lang = 'fr'"))
    if state.write(now, docs.where("lang = 'fr'")) != second:
        raise AssertionError("a run without changes wrote a version")
    return state.read(first).select(F.lit(1).alias("version"), "doc_id", "sha256").unionByName(state.read(second).select(F.lit(2).alias("version"), "doc_id", "sha256"))
