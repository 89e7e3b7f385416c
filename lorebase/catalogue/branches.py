"""Column functions and small operators over inputs derived from the tables, a case of each kind in every few rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase import rules
from lorebase.catalogue.registry import query, quoted, strip
from lorebase.functions import intent as I
from lorebase.functions import terms as Q
from lorebase.functions import text as T
from lorebase.functions import values as V
from lorebase.operators import digest, grouping, indexing, messages, search
from lorebase.sources import chat, mail
from lorebase.sources.adapters import table


def _case(column: str, *values: str) -> str:
    """SQL that picks one of several expressions by the remainder of a column; both engines read it."""
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(values)) + " END"


_SAID = _case("(conv_id + turn)", "text", "' /help me'", "'/asking'", "'note it'")
_CHAT = _case("turn", "'group'", "'p2p'", "'group'")


@query("reply_rules", f"""
    SELECT conv_id, turn, chat = 'p2p' OR {' OR '.join(f"starts_with({strip('said')}, {quoted(c)})" for c in rules.REPLY_COMMANDS)} OR mentioned AS strict, true AS loose
    FROM (SELECT conv_id, turn, {_SAID} AS said, {_CHAT} AS chat, conv_id % 4 = 1 AS mentioned FROM conversations)""")
def reply_rules(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.expr(_SAID).alias("said"), F.expr(_CHAT).alias("chat"), (F.col("conv_id") % 4 == 1).alias("mentioned"))
    said = [F.col(c) for c in ("said", "chat", "mentioned")]
    return rows.select("conv_id", "turn", I.should_reply(*said).alias("strict"), I.should_reply(*said, only_when_mentioned=False).alias("loose"))


_KIND = _case("p_partkey", "'text'", "'post'", "'file'", "'image'", "'audio'", "'file'")
_BODY = _case(
    "p_partkey", """'{"text": "  @Bot  hello\\t' || p_name || '"}'""", """'{"title": "T ' || p_partkey || '", "content": [[{"tag": "text", "text": "one"}, {"tag": "a", "un_escape_text": "two"}]]}'""",
    """'{"file_key": "k' || p_partkey || '", "file_name": "f.pdf", "mime_type": "application/pdf", "file_size": "12"}'""", """'{"image_key": "i' || p_partkey || '"}'""",
    """'{"file_key": "a' || p_partkey || '"}'""", """'{"file_name": "lost.pdf"}'""")


@query("polled_bodies", f"""
    SELECT p_partkey, CASE k WHEN 0 THEN 'hello ' || p_name WHEN 1 THEN 'T ' || p_partkey || chr(10) || 'one' || chr(10) || 'two' WHEN 2 THEN 'f.pdf' WHEN 3 THEN 'i' || p_partkey WHEN 5 THEN 'lost.pdf' ELSE '' END AS text,
        CASE k WHEN 2 THEN 'k' WHEN 3 THEN 'i' WHEN 4 THEN 'a' END || p_partkey AS file_key, CASE k WHEN 2 THEN 'f.pdf' WHEN 3 THEN 'image_m' || p_partkey || '.jpg' WHEN 4 THEN 'audio' END AS file_name,
        CASE k WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'image/jpeg' WHEN 4 THEN '' END AS mime_type, CASE k WHEN 2 THEN 12::BIGINT END AS file_size
    FROM (SELECT *, p_partkey % 6 AS k FROM part)""")
def polled_bodies(spark, folder):
    """Message bodies of six kinds: what there is to read in them, and the file they carry."""
    rows = table(spark, folder, "part").select("p_partkey", F.expr(_KIND).alias("kind"), F.expr(_BODY).alias("body"))
    mentions = F.expr("array(named_struct('key', '@_user_1', 'id', 'x', 'id_type', '', 'name', 'Bot'))")
    items = I.file_items(F.col("body"), F.col("kind"), F.concat(F.lit("m"), "p_partkey"))
    file = F.get(items, F.lit(0))
    return rows.select("p_partkey", I.message_text(F.col("body"), F.col("kind"), mentions).alias("text"), *[file[c].alias(c) for c in ("file_key", "file_name", "mime_type", "file_size")])


_REPLY = _case("doc_id", "'Sure: ' || chr(10) || '```json' || chr(10) || '{\"a\": {\"b\": ' || doc_id || '}}' || chr(10) || '``` done'", "'no object'", "'{\"c\": 1}'")


@query("text_limits", f"""
    SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || ' [cut]' ELSE text END AS cut,
        CASE doc_id % 3 WHEN 0 THEN '{{"a": {{"b": ' || doc_id || '}}}}' WHEN 1 THEN '' ELSE '{{"c": 1}}' END AS found, 'a%20b/' || doc_id || '#x%25~%2A%C3%A9' AS link FROM documents""".replace("%25~", "%~"))
def text_limits(spark, folder):
    """Texts cut with a marker, the object in a model's reply, and a path made fit for a link."""
    return table(spark, folder, "documents").select(
        "doc_id", T.truncate_with_marker(F.col("text"), 500, " [cut]").alias("cut"), T.json_object_text(F.expr(_REPLY)).alias("found"),
        T.url_path_quote(F.concat(F.lit("a b/"), "doc_id", F.lit("#x%~*é"))).alias("link"))


_IDS = _case("event_id", "event_id::VARCHAR", "'x' || event_id", "'007'", "'12a'").replace("event_id::VARCHAR", "cast(event_id as string)")


@query("numeric_order", f"""
    SELECT event_id, row_number() OVER (ORDER BY CASE WHEN regexp_matches(k, '^\\d+$') THEN 0 ELSE 1 END, CASE WHEN regexp_matches(k, '^\\d+$') THEN k::HUGEINT END, CASE WHEN NOT regexp_matches(k, '^\\d+$') THEN k END, event_id) AS place
    FROM (SELECT event_id, {_IDS} AS k FROM events WHERE user_id < 40)""")
def numeric_order(spark, folder):
    """Ids that are numbers in numeric order, then the others as text."""
    rows = table(spark, folder, "events").where("user_id < 40").select("event_id", messages.numeric_first(F.expr(_IDS)).alias("k"))
    flat = rows.select("event_id", F.col("k.group").alias("g"), F.col("k.number").alias("number"), F.coalesce("k.text", F.lit("")).alias("t"))
    return grouping.numbered_by_range(flat, [], ["g", "number", "t", "event_id"], "place").select("event_id", "place")


_MAIL_DATE = _case("event_id", "'Tue, 14 Nov 2023 22:13:' || lpad(cast(event_id % 60 as string), 2, '0') || ' +0800'", "'14 Nov 2023 22:13:20 GMT'", "'Tue, 14 Nov 2023 22:13 -0500 (EST)'", "'soon'", "''")


@query("mail_dates", """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN '2023-11-14T14:13:' || lpad((event_id % 60)::VARCHAR, 2, '0') || 'Z' WHEN 1 THEN '2023-11-14T22:13:20Z' WHEN 2 THEN '2023-11-15T03:13:00Z' END AS at FROM events""")
def mail_dates(spark, folder):
    return table(spark, folder, "events").select("event_id", V.iso(V.mail_time(F.expr(_MAIL_DATE))).alias("at"))


_HAN = "translate(substr(text, 1, 12), 'aeiournts ', '光学真空我们烘烤腔镜')"
_HAN_ONLY = "list_filter(string_split(h, ''), lambda x: regexp_matches(x, '[\\x{3400}-\\x{9fff}]') AND NOT contains('" + rules.CHUNK_STOP_CHARS + "', x))"


@query("cjk_terms", f"""
    WITH t AS (SELECT doc_id, {_HAN_ONLY.replace('h,', _HAN + ',')} AS c FROM documents),
    g AS (SELECT doc_id, list_concat(list_concat(list_transform(range(1, len(c)), lambda i: array_to_string(c[i:i + 1], '')), list_transform(range(1, len(c) - 1), lambda i: array_to_string(c[i:i + 2], ''))),
        list_transform(range(1, len(c) - 2), lambda i: array_to_string(c[i:i + 3], ''))) AS g FROM t),
    u AS (SELECT doc_id, unnest(g) AS term, generate_subscripts(g, 1) AS n FROM g)
    SELECT doc_id, string_agg(term, '|' ORDER BY n) AS terms FROM (SELECT doc_id, term, min(n) AS n FROM u GROUP BY ALL) GROUP BY doc_id""")
def cjk_terms(spark, folder):
    """Runs of two, three and four Chinese characters, with whatever stands between them and the stop characters gone."""
    han = F.expr(_HAN)
    rows = table(spark, folder, "documents").select("doc_id", F.filter(Q.terms_column(han), lambda t: t.rlike(rf"^{rules.CJK}+$")).alias("terms"))
    return rows.where(F.size("terms") > 0).select("doc_id", F.array_join("terms", "|").alias("terms"))


@query("mail_actions", """
    WITH m AS (SELECT doc_id AS uid, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'm' || (doc_id // 2) END AS message_id, 's' || (doc_id % 11) AS sender FROM documents WHERE doc_id % 13 <> 1),
    f AS (SELECT message_id, min(uid) AS first FROM m WHERE message_id <> '' AND sender <> 's3' GROUP BY 1)
    SELECT uid, CASE WHEN sender = 's3' THEN 'ignored' WHEN message_id IN ('m7', 'm20') OR (message_id <> '' AND uid <> first) THEN 'known' ELSE 'archive' END AS action FROM m LEFT JOIN f USING (message_id)""")
def mail_actions(spark, folder):
    """New mail against the mail state: processed uids, known and repeated message ids, a muted sender, mail without an id."""
    docs = table(spark, folder, "documents")
    records = docs.select(F.col("doc_id").alias("uid"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("m"), F.expr("doc_id div 2"))).alias("message_id"), F.concat(F.lit("s"), F.col("doc_id") % 11).alias("sender"))
    known = spark.createDataFrame([("m7",), ("m20",)], "message_id STRING")
    out = mail.new_mail(records, docs.where("doc_id % 13 = 1").select(F.col("doc_id").alias("uid")), known, spark.createDataFrame([("s3",)], "sender STRING"))
    return out.select("uid", "action")


@query("handoff_checks", f"""
    SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'session_id' END, CASE WHEN c_custkey % 5 = 0 THEN 'actor' END, CASE WHEN c_custkey % 7 = 0 THEN 'objective' END) AS problems,
        '# ' || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END || chr(10) || chr(10) || '- Session: ' || CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE 's' || c_custkey END || chr(10) || '- Actor: ' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'a' END
        || {" || ".join(f"chr(10) || chr(10) || '## {h}' || chr(10) || chr(10) || " + ("'- done ' || c_custkey || chr(10) || '- more'" if n == "completed" else "'- None recorded.'") for h, n in (("Current State", "state"), ("Completed", "completed"), ("Decisions", "decisions"), ("Blockers", "blockers"), ("Next Actions", "next_actions"), ("Files To Read", "files_to_read"), ("Changed Files", "changed_files"), ("Notes", "notes")))} AS page
    FROM customer""")
def handoff_checks(spark, folder):
    """Hand-off payloads with blank fields, what is wrong with them, and their pages."""
    key = F.col("c_custkey")
    empty = F.array().cast("array<string>")
    rows = table(spark, folder, "customer").select(
        key, F.when(key % 3 == 0, " ").otherwise(F.concat(F.lit("s"), key)).alias("session_id"), F.when(key % 5 == 0, "").otherwise("a").alias("actor"), F.when(key % 7 == 0, "").otherwise(F.col("c_name")).alias("objective"),
        F.array(F.concat(F.lit("done "), key), F.lit("more")).alias("completed"), *[empty.alias(n) for n in ("state", "decisions", "blockers", "next_actions")], *[F.lit(None).cast("array<string>").alias(n) for n in ("files_to_read", "changed_files", "notes")])
    return rows.select("c_custkey", F.array_join(digest.handoff_problems(), ",").alias("problems"), digest.handoff_fragment().alias("page"))


@query("embedding_inputs", """
    SELECT doc_id, substr(whole, 1, 400) AS limited, length(whole) AS whole
    FROM (SELECT doc_id, 'Section: ' || lang || chr(10) || 'Title: ' || chr(10) || 'Source type: ' || source || chr(10) || 'Date: 2026' || chr(10) || chr(10) || text AS whole FROM documents)""")
def embedding_inputs(spark, folder):
    """What a chunk is embedded from, with and without the service's limit."""
    rows = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("section"), F.lit(None).cast("string").alias("title"), F.col("source").alias("source_type"), F.lit("2026").alias("date"), "text")
    return rows.select("doc_id", indexing.embedding_input(400).alias("limited"), F.length(indexing.embedding_input()).cast("long").alias("whole"))


@query("selected_candidates", """
    SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id * 2 FROM labels)""")
def selected_candidates(spark, folder):
    """Candidates that a model picked; picks may repeat and name none of them."""
    picks = table(spark, folder, "labels").select((F.col("doc_id") * 2).alias("chunk_id"))
    chosen = search.select_candidates(table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id")), picks.unionByName(picks))
    return chosen.select(F.col("chunk_id").alias("doc_id"))


@query("last_of_each", """
    SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def last_of_each(spark, folder):
    return grouping.last_per_key(table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("attachment_sources", """
    SELECT 'f' || p_partkey || '.txt' AS title, 'x/f' || p_partkey || '.txt' AS path, 'read ' || p_name AS text, '2026-06-11' AS date FROM part WHERE p_partkey % 3 = 0""")
def attachment_sources(spark, folder):
    """Files of chat records with their extracts; a third of the records has one that was read."""
    part = table(spark, folder, "part")
    file = F.struct(F.lit("").alias("kind"), F.concat(F.lit("x/f"), "p_partkey", F.lit(".txt")).alias("path"), F.lit("").alias("file_name"), F.lit("").alias("mime_type"), F.lit("").alias("classification"),
                    F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("e/"), "p_partkey", F.lit(".txt"))).otherwise("gone.txt").alias("text_extract"))
    records = part.select(F.lit("r.jsonl").alias("record_path"), F.lit("").alias("created_at"), F.lit("2026-06-11").alias("day"), F.lit("p").alias("person"), F.array(file).alias("files"))
    extracts = part.select(F.concat(F.lit("e/"), "p_partkey", F.lit(".txt")).alias("extract_path"), F.concat(F.lit("read "), "p_name").alias("extract"))
    return chat.attachment_sources(records, extracts, "telegram").select("title", "path", "text", "date")
