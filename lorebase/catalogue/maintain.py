"""Snapshots, merges, upserts, gates, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.catalogue.registry import any_of, compact, fold, matches, query, redact
from lorebase.functions.text import redact as redacted
from lorebase.functions.text import sha256
from lorebase.operators import digest, linediff, noise, snapshots, topics
from lorebase.sources.adapters import table

# The earlier run knew the English, French and German documents as they were; this run sees the English, German and
# Spanish ones after redaction.
_OLD = "old AS (SELECT 'doc:' || doc_id AS key, doc_id, sha256(text) AS sha FROM documents WHERE lang IN ('en', 'fr', 'de'))"
_NEW = f"new AS (SELECT 'doc:' || doc_id AS key, doc_id, sha256({redact('text')}) AS sha FROM documents WHERE lang IN ('en', 'de', 'es'))"


def _state(documents, text):
    return documents.select(
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("key"), F.col("lang").alias("section"), F.col("source").alias("title"),
        F.concat(F.lit("documents/"), F.col("doc_id")).alias("html"), sha256(text).alias("sha256"),
        F.lit("").alias("created"), F.lit("").alias("updated"), text.alias("text"),
    )


def two_snapshots(spark, folder):
    docs = table(spark, folder, "documents")
    previous = _state(docs.filter(F.col("lang").isin("en", "fr", "de")), F.col("text"))
    current = _state(docs.filter(F.col("lang").isin("en", "de", "es")), redacted(F.col("text")))
    return previous, current


@query("snapshot_diff", f"""
    WITH {_OLD}, {_NEW} SELECT coalesce(old.key, new.key) AS key, CASE WHEN old.key IS NULL THEN 'added' WHEN new.key IS NULL THEN 'removed'
        ELSE 'modified' END AS type, old.sha AS previous_sha256, new.sha AS current_sha256
    FROM old FULL JOIN new ON old.key = new.key WHERE old.sha IS DISTINCT FROM new.sha""")
def snapshot_diff(spark, folder):
    return snapshots.diff_snapshots(*two_snapshots(spark, folder)).select("key", "type", "previous_sha256", "current_sha256")


@query("change_counts", f"""
    WITH {_OLD}, {_NEW} SELECT count(*) FILTER (old.key IS NULL) AS added,
        count(*) FILTER (old.sha <> new.sha) AS modified, count(*) FILTER (new.key IS NULL) AS removed
    FROM old FULL JOIN new ON old.key = new.key""")
def change_counts(spark, folder):
    return snapshots.change_counts(snapshots.diff_snapshots(*two_snapshots(spark, folder)))


def _starts(sign):
    return lambda line: F.startswith(line, F.lit(sign))


_NET = """array_to_string(list_sort(flatten(list_transform(list_distinct({0}), lambda l: list_transform(
    range(greatest(0, len(list_filter({0}, lambda x: x = l)) - len(list_filter({1}, lambda x: x = l)))), lambda i: l)))), chr(10))"""


@query("change_net_lines", f"""
    WITH {_OLD}, {_NEW}, c AS (SELECT coalesce(old.key, new.key) AS key, coalesce(old.doc_id, new.doc_id) AS doc_id,
        CASE WHEN old.key IS NULL THEN 'added' WHEN new.key IS NULL THEN 'removed' ELSE 'modified' END AS type
        FROM old FULL JOIN new ON old.key = new.key WHERE old.sha IS DISTINCT FROM new.sha),
    l AS (SELECT key, type, lang AS section, CASE WHEN type = 'added' THEN substr({compact(redact('text'))}, 1, 1000) END AS text_preview,
        string_split(text, chr(10)) AS o, string_split({redact('text')}, chr(10)) AS n FROM c JOIN documents USING (doc_id))
    SELECT key, type, section, text_preview, CASE WHEN type = 'modified' THEN {_NET.format('o', 'n')} END AS net_removed,
        CASE WHEN type = 'modified' THEN {_NET.format('n', 'o')} END AS net_added FROM l""")
def change_net_lines(spark, folder):
    """What the line diffs of the changed pages take away and add in the end, moved lines left out."""
    previous, current = two_snapshots(spark, folder)
    records = snapshots.change_records(snapshots.diff_snapshots(previous, current), previous, current, "2026-06-12T02:00:00+00:00", 1 << 30)
    body = F.expr("slice(diff, 3, greatest(size(diff) - 2, 0))")
    lines = records.select("key", "type", "section", "text_preview", *[
        F.transform(F.filter(body, _starts(sign)), lambda x: F.substr(x, F.lit(2))).alias(name)
        for sign, name in (("-", "gone"), ("+", "come"))])

    def net(one: str, other: str) -> F.Column:
        count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
        each = F.transform(F.array_distinct(one), lambda x: F.array_repeat(x, F.greatest(F.lit(0), count(one, x) - count(other, x))))
        return F.when(F.col("type") == "modified", F.array_join(F.sort_array(F.flatten(each)), "\n"))

    return lines.select("key", "type", "section", "text_preview", net("gone", "come").alias("net_removed"), net("come", "gone").alias("net_added"))


# A redacted line stays where it was, so changed places show what a diff of these pages has to be.
@query("change_hunks", f"""
    WITH {_OLD}, {_NEW}, c AS (SELECT old.key, string_split(d.text, chr(10)) AS o, string_split({redact('d.text')}, chr(10)) AS n
        FROM old JOIN new ON old.key = new.key JOIN documents d ON d.doc_id = old.doc_id WHERE old.sha <> new.sha),
    l AS (SELECT key, unnest(range(1, len(o) + 1)) AS i, unnest(o) AS a, unnest(n) AS b FROM c),
    s AS (SELECT *, max(CASE WHEN a <> b THEN i END) OVER (PARTITION BY key ORDER BY i) AS last,
        min(CASE WHEN a <> b THEN i END) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM l),
    h AS (SELECT *, coalesce(i - last <= 3, false) OR coalesce(next - i <= 3, false) AS near FROM s),
    g AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY i) AS hunk, sum(CASE WHEN a = b THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS run FROM h),
    r AS (SELECT key, hunk, i, run, 2 AS kind, ' ' || a AS line FROM g WHERE near AND a = b
        UNION ALL SELECT key, hunk, i, run, 3, '-' || a FROM g WHERE a <> b UNION ALL SELECT key, hunk, i, run, 4, '+' || b FROM g WHERE a <> b)
    SELECT key, (row_number() OVER (PARTITION BY key ORDER BY hunk))::INT AS hunk, min(i) AS old_start, count(DISTINCT i) AS old_lines, min(i) AS new_start,
        count(DISTINCT i) AS new_lines, string_agg(line, chr(10) ORDER BY run, kind, i) AS body FROM r GROUP BY key, hunk""")
def change_hunks(spark, folder):
    """The line diffs of the changed pages, hunk by hunk, with three lines around each change."""
    previous, current = two_snapshots(spark, folder)
    changed = snapshots.diff_snapshots(previous, current).where("type = 'modified'").select("key")
    pages = changed.join(previous.select("key", F.col("text").alias("old_text")), "key").join(current.select("key", "text"), "key")
    hunks = linediff.line_hunks(pages)
    return hunks.withColumn("body", F.array_join(F.transform("lines", lambda x: F.concat(x["sign"], x["text"])), "\n")).drop("lines")


@query("change_records")
def change_records(spark, folder):
    """The change log's rows with their diff."""
    previous, current = two_snapshots(spark, folder)
    return snapshots.change_records(snapshots.diff_snapshots(previous, current), previous, current, "2026-06-12T02:00:00+00:00")


@query("change_log", f"""
    WITH {_OLD}, {_NEW}, removed AS (SELECT 'doc:' || doc_id AS key, lang, source, doc_id, sha256(text) AS sha FROM documents WHERE lang = 'fr')
    SELECT key, '## REMOVED | ' || lang || ' / ' || source || chr(10) || chr(10) || '- HTML: `documents/' || doc_id || '`' || chr(10)
        || '- Previous SHA-256: `' || sha || '`' || chr(10) || '- Current SHA-256: ``' || chr(10) || '- Detected at: 2026-06-12T02:00:00+00:00'
        || chr(10) || chr(10) || '```diff' || chr(10) || '--- previous' || chr(10) || '+++ current' || chr(10) || '@@ removed page @@' || chr(10)
        || '```' || chr(10) AS fragment FROM removed""")
def change_log(spark, folder):
    """Change-log sections of the removed pages."""
    previous, current = two_snapshots(spark, folder)
    removed = snapshots.diff_snapshots(previous, current).filter(F.col("type") == "removed")
    records = snapshots.change_records(removed, previous, current, "2026-06-12T02:00:00+00:00")
    return records.select("key", digest.change_fragment().alias("fragment"))


_MERGE = f"""
    active AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE lang <> 'es'),
    incoming AS (SELECT doc_id, sha256({redact('text')}) AS sha FROM documents),
    merged AS (SELECT incoming.doc_id, CASE WHEN active.sha IS NULL THEN 'added' WHEN active.sha = incoming.sha THEN 'duplicate' ELSE 'updated' END AS status
        FROM incoming LEFT JOIN active USING (doc_id))"""


def _merged(spark, folder):
    docs = table(spark, folder, "documents")
    active = docs.filter(F.col("lang") != "es").select(F.col("doc_id").alias("key"), sha256(F.col("text")).alias("sha256"))
    incoming = docs.select(F.col("doc_id").alias("key"), sha256(redacted(F.col("text"))).alias("sha256"))
    return snapshots.merge_status(incoming, active)


@query("incoming_merge", f"WITH {_MERGE} SELECT doc_id, status FROM merged")
def incoming_merge(spark, folder):
    return _merged(spark, folder).select(F.col("key").alias("doc_id"), "status")


@query("merge_counts", f"""
    WITH {_MERGE} SELECT count(*) FILTER (status = 'added') AS added_pages, count(*) FILTER (status = 'updated') AS updated_pages,
        count(*) FILTER (status = 'duplicate') AS duplicate_pages FROM merged""")
def merge_counts(spark, folder):
    return snapshots.merge_counts(_merged(spark, folder))


@query("copy_plan", f"""
    SELECT 'in/' || d.doc_id AS path, CASE WHEN quality IS NULL THEN 'missing' WHEN lang <> 'es' AND sha256(text) = sha256({redact('text')})
        THEN 'duplicate' ELSE 'copied' END AS status, quality IS NOT NULL AS may_delete FROM documents d LEFT JOIN labels USING (doc_id)""")
def copy_plan(spark, folder):
    """Files of the labelled documents are there, the others are gone; the target holds the unredacted ones."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels").select("doc_id", "quality")
    path = F.concat(F.lit("in/"), F.col("doc_id"))
    there = docs.join(labels, "doc_id", "left")
    incoming = there.select(path.alias("path"), F.when(F.col("quality").isNotNull(), sha256(redacted(F.col("text")))).alias("sha256"))
    target = docs.filter(F.col("lang") != "es").select(path.alias("path"), sha256(F.col("text")).alias("sha256"))
    plan = snapshots.copy_plan(incoming, target)
    deletable = snapshots.deletion_plan(plan, "in").withColumn("may_delete", F.lit(True))
    return plan.join(deletable, "path", "left").select("path", "status", F.coalesce("may_delete", F.lit(False)).alias("may_delete"))


_UPSERT = """
    existing AS (SELECT doc_id AS ordinal, 'p/' || doc_id AS html, sha256(text) AS sha FROM documents),
    fresh AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, 1000000000 + doc_id AS ordinal, CASE WHEN toxic = 0 THEN 'p/' || doc_id ELSE 'moved/' || doc_id END AS html,
        CASE WHEN quality = 1 THEN sha256(text) ELSE sha256(text || '!') END AS sha FROM documents JOIN labels USING (doc_id)),
    steps AS (
        SELECT 0::BIGINT AS n, (SELECT list({'ordinal': ordinal, 'html': html, 'sha': sha, 'origin': 'kept'} ORDER BY ordinal) FROM existing) AS pages
        UNION ALL
        SELECT n, CASE WHEN spot IS NULL THEN list_append(pages, {'ordinal': ordinal, 'html': html, 'sha': sha, 'origin': 'appended'}) ELSE list_concat(list_append(
            pages[:spot - 1], {'ordinal': pages[spot].ordinal, 'html': html, 'sha': sha, 'origin': CASE pages[spot].origin WHEN 'appended' THEN 'appended' ELSE 'replaced' END}), pages[spot + 1:]) END
        FROM (SELECT f.*, pages, list_position(list_transform(pages, lambda p: p.html = f.html OR p.sha = f.sha), true) AS spot FROM steps s JOIN fresh f ON f.n = s.n + 1)
    )"""


@query("upsert_or_key", f"""
    WITH RECURSIVE {_UPSERT}
    SELECT p.ordinal, p.html, p.sha AS source_sha256, p.origin FROM (SELECT unnest(pages) AS p FROM steps WHERE n = (SELECT max(n) FROM steps))""")
def upsert_or_key(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    existing = docs.select(
        F.col("doc_id").alias("ordinal"), F.concat(F.lit("p/"), F.col("doc_id")).alias("html"), sha256(F.col("text")).alias("source_sha256")
    )
    body = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit("!")))
    new = docs.join(labels, "doc_id").select(
        (F.col("doc_id") + 1000000000).alias("ordinal"),
        F.concat(F.when(F.col("toxic") == 0, "p/").otherwise("moved/"), F.col("doc_id")).alias("html"),
        sha256(body).alias("source_sha256"),
    )
    return snapshots.upsert_pages(existing, new)


@query("upsert_by_title", """
    SELECT coalesce(d.lang, l.lang) AS section, coalesce(d.title, l.title) AS title, coalesce(l.version, d.version) AS version
    FROM (SELECT lang, 'page ' || doc_id AS title, 'old' AS version FROM documents WHERE lang <> 'es') d
    FULL JOIN (SELECT lang, 'page ' || doc_id AS title, 'new ' || quality AS version FROM documents JOIN labels USING (doc_id)) l
    ON d.lang = l.lang AND d.title = l.title""")
def upsert_by_title(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    title = F.concat(F.lit("page "), F.col("doc_id"))
    existing = docs.filter(F.col("lang") != "es").select(F.col("lang").alias("section"), title.alias("title"), F.lit("old").alias("version"))
    new = docs.join(labels, "doc_id").select(
        F.col("lang").alias("section"), title.alias("title"), F.concat(F.lit("new "), F.col("quality")).alias("version")
    )
    return snapshots.upsert_by_title(existing, new)


@query("prune_and_order", """
    SELECT d.doc_id, coalesce(quality, 9999)::BIGINT AS section_index, coalesce(toxic, 9999)::BIGINT AS page_order
    FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NOT NULL OR lang NOT IN ('en', 'fr')""")
def prune_and_order(spark, folder):
    """The manifest knows the labelled documents; pruning is limited to the English and French sections."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("doc_id").alias("html"), F.col("lang").alias("section"))
    manifest = table(spark, folder, "labels").select(
        F.col("doc_id").alias("html"), F.col("quality").alias("section_index"), F.col("toxic").alias("page_order")
    )
    pruned = snapshots.prune_and_order(docs, manifest, scoped_sections=("en", "fr"))
    return pruned.select("doc_id", F.col("section_index").cast("bigint").alias("section_index"), F.col("page_order").cast("bigint").alias("page_order"))


@query("stale_pages", f"""
    SELECT d.doc_id AS id FROM documents d LEFT JOIN (SELECT doc_id, sha256(text) AS seen FROM documents WHERE lang <> 'es') s USING (doc_id)
    WHERE seen IS NULL OR seen <> sha256({redact('text')})""")
def stale_pages(spark, folder):
    docs = table(spark, folder, "documents")
    pages = docs.select(F.col("doc_id").alias("id"), sha256(redacted(F.col("text"))).alias("modified"))
    state = docs.filter(F.col("lang") != "es").select(F.col("doc_id").alias("id"), sha256(F.col("text")).alias("modified"))
    return snapshots.stale_pages(pages, state).select("id")


@query("notebook_match", """
    SELECT n_nationkey::BIGINT AS ordinal, n_name AS name FROM (SELECT *, CASE WHEN lower(n_name) = 'tion_2' THEN 0 ELSE 1 END AS r FROM nation
        WHERE contains(lower(n_name), 'tion_2')) ORDER BY r, n_nationkey LIMIT 1""")
def notebook_match(spark, folder):
    names = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("ordinal"), F.col("n_name").alias("name"))
    return snapshots.best_name_match(names, "Tion_2")


@query("section_names", """
    SELECT c_custkey AS page_id, n_name AS section, r_name AS notebook FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""")
def section_names(spark, folder):
    """Page -> section -> notebook names by parent id (customers, nations and regions stand in)."""
    pages = table(spark, folder, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_nationkey").alias("section_id"))
    sections = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("section_id"), F.col("n_name").alias("section"), F.col("n_regionkey").alias("notebook_id"))
    notebooks = table(spark, folder, "region").select(F.col("r_regionkey").alias("notebook_id"), F.col("r_name").alias("notebook"))
    return pages.join(sections, "section_id").join(notebooks, "notebook_id").select("page_id", "section", "notebook")


# --- gates and topics -------------------------------------------------------------------------------------------
HINTS, NOISE = ("thation", "nichte", "version"), ("token", "license", "pour", "que")
_RECORDS = "SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations"


@query("noise_gate_index", f"""
    SELECT id, NOT {any_of(fold('text'), HINTS)} AND {any_of(fold('text'), NOISE)} AS noise FROM ({_RECORDS})""")
def noise_gate_index(spark, folder):
    docs = table(spark, folder, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    chat = table(spark, folder, "conversations").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), "text")
    return docs.unionByName(chat).select("id", noise.is_index_noise(F.col("text"), HINTS, NOISE).alias("noise"))


OTP, ADS = (r"\btoken\s+=", r"\b(?:version|license) 3\b"), (r"\blicense\b",)
DIGEST_HINTS, WEAK = ("apache", "heit"), ("with", "les", "para", "und")


@query("noise_gate_digest", f"""
    WITH j AS (SELECT doc_id, quality, CASE WHEN {matches(fold('text'), OTP)} THEN 'verification_or_login_code'
            WHEN {matches(fold('text'), ADS)} AND NOT {any_of(fold('text'), DIGEST_HINTS)} THEN 'advertising_or_newsletter' ELSE '' END AS rule,
            NOT {any_of(fold('text'), DIGEST_HINTS)} AND {any_of(fold('text'), WEAK)} AS weak FROM documents LEFT JOIN labels USING (doc_id)),
    r AS (SELECT doc_id, weak AND rule = '' AS uncertain, CASE WHEN rule <> '' THEN rule WHEN weak AND quality = 0 THEN 'low quality' ELSE '' END AS reason FROM j)
    SELECT doc_id, uncertain, reason, reason = '' AS kept FROM r""")
def noise_gate_digest(spark, folder):
    decisions = table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("keep"), F.lit("low quality").alias("reason"))
    gated = noise.gate_records(table(spark, folder, "documents"), decisions, "doc_id", "text", DIGEST_HINTS, OTP, ADS, WEAK)
    return gated.select("doc_id", "uncertain", "reason", "kept")


_COVER = """
    claims AS (SELECT 'doc:' || CASE WHEN toxic = 1 THEN -doc_id ELSE doc_id END AS record_id,
        CASE WHEN quality = 1 THEN lang ELSE 'Nope' END AS section, 'quality ' || quality AS topic FROM labels JOIN documents USING (doc_id)),
    records AS (SELECT 'doc:' || doc_id AS record_id FROM documents),
    sections AS (SELECT DISTINCT lang AS section FROM documents),
    placed AS (SELECT record_id, CASE WHEN section IN (SELECT section FROM sections) THEN section ELSE 'Unsorted Communication Records' END AS section,
        topic AS topic_title, 'group' AS origin FROM claims WHERE record_id IN (SELECT record_id FROM records)),
    covered AS (SELECT * FROM placed UNION ALL
        SELECT record_id, 'Unsorted Communication Records', 'Email supplement 2026-06-12', 'fallback' FROM records
        WHERE record_id NOT IN (SELECT record_id FROM placed))"""


def _covered(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    member = F.when(F.col("toxic") == 1, -F.col("doc_id")).otherwise(F.col("doc_id"))
    claims = labels.join(docs.select("doc_id", "lang"), "doc_id").select(
        F.concat(F.lit("doc:"), member).alias("record_id"), F.when(F.col("quality") == 1, F.col("lang")).otherwise("Nope").alias("section"),
        F.concat(F.lit("quality "), F.col("quality")).alias("topic_title"),
    )
    records = docs.select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("record_id"))
    return topics.cover_records(claims, records, docs.select(F.col("lang").alias("section")), "email", "2026-06-12")


@query("topic_groups_coverage", f"WITH {_COVER} SELECT record_id, section, topic_title, origin FROM covered")
def topic_groups_coverage(spark, folder):
    return _covered(spark, folder)


@query("topic_supplements", f"""
    WITH {_COVER} SELECT section, topic_title || ' Supplement 2026-06-12 [email]' AS title, count(*) AS records, min(record_id) AS first_record
    FROM covered GROUP BY ALL""")
def topic_supplements(spark, folder):
    return topics.supplement_pages(_covered(spark, folder), "email", "2026-06-12")


@query("fallback_facts", f"""
    SELECT doc_id, source || ': ' || substr(text, 1, 500) AS fact FROM documents ORDER BY doc_id LIMIT 30""")
def fallback_facts(spark, folder):
    records = table(spark, folder, "documents").withColumnRenamed("source", "label")
    return topics.fallback_facts(records, "doc_id")


@query("section_directory", f"""
    SELECT section, doc_id, title, rank FROM (SELECT lang AS section, doc_id, {compact('substr(text, 1, 80)')} AS title,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 25""")
def section_directory(spark, folder):
    from lorebase.functions.text import compact as flat

    pages = table(spark, folder, "documents").select(F.col("lang").alias("section"), "doc_id", F.substring("text", 1, 80).alias("title"))
    first = topics.section_directory(pages, "doc_id")
    return first.select("section", "doc_id", flat(F.col("title")).alias("title"), F.col("rank").cast("bigint").alias("rank"))


@query("set_algebra", """
    SELECT 'both' AS side, doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
    UNION ALL SELECT 'unlabelled', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    UNION ALL SELECT 'any', doc_id FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)""")
def set_algebra(spark, folder):
    docs, labels = table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels").select("doc_id")
    parts = [("both", docs.intersect(labels)), ("unlabelled", docs.subtract(labels)), ("any", docs.union(labels).distinct())]
    first, *rest = [df.select(F.lit(side).alias("side"), "doc_id") for side, df in parts]
    for df in rest:
        first = first.unionByName(df)
    return first
