"""Message feeds, conversations and daily digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase import rules
from lorebase.catalogue.registry import any_of, query, redact
from lorebase.functions import text as T
from lorebase.functions import values as V
from lorebase.operators import digest, messages
from lorebase.operators.grouping import ROWS_PER_BLOCK, TEXTS_PER_BLOCK
from lorebase.sources.adapters import table

NOW = "2024-01-30 12:00:00"


def _day():
    return F.date_format("ts", "yyyy-MM-dd")


@query("char_budget", """
    WITH summed AS (SELECT conv_id, turn, '[' || role || '] ' AS header, text, coalesce(sum(length(role) + 3 + length(text)) OVER
        (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix FROM conversations)
    SELECT conv_id, turn, prefix, header || substr(text, 1, 2000 - prefix) AS chat_block, substr(header || text, 1, 2000 - prefix) AS mail_block
    FROM summed WHERE prefix < 2000""")
def char_budget(spark, folder):
    records = table(spark, folder, "conversations")
    header = F.concat(F.lit("["), F.col("role"), F.lit("] "))
    block = F.floor(F.col("turn") / TEXTS_PER_BLOCK)
    chat = digest.within_budget(records, ["conv_id"], ["turn"], block, header, F.col("text"), 2000)
    left = (F.lit(2000) - F.col("prefix")).cast("int")
    return chat.select(
        "conv_id", "turn", "prefix", F.col("block").alias("chat_block"),
        F.substring(F.concat(header, F.col("text")), F.lit(1), left).alias("mail_block"),
    )


_LOG_CUT = "'[TRUNCATED: latest work-log tail only]' || chr(10) || right(text, 3000)"
_FILE_CUT = "substr(text, 1, 3000) || chr(10) || chr(10) || '[TRUNCATED after 3000 chars]'"


@query("doc_budget", f"""
    WITH shown AS (SELECT doc_id, source, CASE WHEN length(text) > 3000 AND lang = 'de' THEN {_LOG_CUT} WHEN length(text) > 3000 THEN {_FILE_CUT}
        ELSE text END AS s FROM documents),
    summed AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix FROM shown)
    SELECT doc_id, prefix, CASE WHEN length(s) > 30000 - prefix THEN substr(s, 1, 30000 - prefix) || chr(10) || chr(10) || '[TRUNCATED by total prompt budget]'
        ELSE s END AS included FROM summed WHERE prefix < 30000""")
def doc_budget(spark, folder):
    docs = table(spark, folder, "documents")
    fitted = digest.doc_budget(
        docs, ["source"], ["doc_id"], F.floor(F.col("doc_id") / TEXTS_PER_BLOCK), F.col("text"), F.col("lang") == "de", per_file=3000, total=30000
    )
    return fitted.select("doc_id", "prefix", "included")


@query("recent_turns", """
    SELECT conv_id, turn, turns_back FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS turns_back
        FROM conversations) WHERE turns_back <= 6""")
def recent_turns(spark, folder):
    last = messages.recent_turns(table(spark, folder, "conversations"), "conv_id", "turn")
    return last.select("conv_id", "turn", F.col("turns_back").cast("bigint").alias("turns_back"))


@query("context_window_age", f"""
    WITH past AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events WHERE ts <= TIMESTAMP '{NOW}')
    SELECT user_id, event_id, back AS turns_back FROM past WHERE back <= 6 AND epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) <= 21600""")
def context_window_age(spark, folder):
    now = F.lit(NOW).cast("timestamp_ntz")
    past = table(spark, folder, "events").filter(F.col("ts") <= now).withColumn("at", F.struct("ts", "event_id"))
    age = F.unix_timestamp(now) - F.unix_timestamp("ts")
    recent = messages.recent_turns(past, "user_id", "at", age, max_age=21600)
    return recent.select("user_id", "event_id", F.col("turns_back").cast("bigint").alias("turns_back"))


@query("mode_machine", """
    SELECT event_id, coalesce(last_value(CASE event_type WHEN 'signup' THEN 'record' WHEN 'purchase' THEN 'ask' END IGNORE NULLS) OVER
        (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'ask') AS mode FROM events""")
def mode_machine(spark, folder):
    """signup opens and purchase closes record mode."""
    command = F.when(F.col("event_type") == "signup", "record_on").when(F.col("event_type") == "purchase", "record_off")
    events = table(spark, folder, "events")
    return messages.modes(events, "user_id", ["ts", "event_id"], F.date_trunc("minute", "ts"), command).select("event_id", "mode")


_MESSAGE_ID = "user_id || ':' || json_extract_string(props, '$.k')"


def feed(spark, folder):
    """events as polled messages; an id is a user and the number in the payload, so ids repeat."""
    key = F.concat(F.col("user_id"), F.lit(":"), F.get_json_object("props", "$.k"))
    return table(spark, folder, "events").select(
        key.alias("message_id"), "event_id", "ts", F.col("user_id").alias("chat_id"),
        F.when(F.col("event_type") == "error", "System").otherwise(F.col("event_type")).alias("msg_type"),
    )


@query("dedupe_messages", f"""
    WITH m AS (SELECT {_MESSAGE_ID} AS message_id, event_id, ts, event_type FROM events),
    seen AS (SELECT DISTINCT message_id FROM m WHERE ts < TIMESTAMP '2024-01-03')
    SELECT message_id, min_by(event_id, (ts, event_id)) AS event_id FROM m
    WHERE event_type <> 'error' AND message_id NOT IN (SELECT message_id FROM seen) GROUP BY 1""")
def dedupe_messages(spark, folder):
    polled = feed(spark, folder)
    seen = polled.filter(F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz"))
    return messages.new_messages(polled, seen, "message_id", ["ts", "event_id"]).select("message_id", "event_id")


@query("bootstrap_backfill", f"""
    WITH known AS (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02'),
    seen AS (SELECT DISTINCT {_MESSAGE_ID} AS message_id FROM events WHERE ts < TIMESTAMP '2024-01-10'),
    m AS (SELECT event_id, user_id, {_MESSAGE_ID} AS message_id FROM events)
    SELECT event_id, CASE WHEN message_id IN (SELECT message_id FROM seen) THEN 'seen'
        WHEN user_id NOT IN (SELECT user_id FROM known) THEN 'backfill' ELSE 'live' END AS action FROM m""")
def bootstrap_backfill(spark, folder):
    polled = feed(spark, folder)
    known = polled.filter(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz"))
    seen = polled.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    return messages.bootstrap_split(polled, known, seen, "message_id", "chat_id").select("event_id", "action")


@query("late_reorder", """
    WITH m AS (SELECT event_id, epoch_us(ts) - json_extract_string(props, '$.k')::BIGINT * 60000000 AS created FROM events),
    seen AS (SELECT *, max(created) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM m)
    SELECT event_id, created, latest - created AS late_by FROM seen WHERE created < latest""")
def late_reorder(spark, folder):
    """Rows older than something that arrived before them; the event time lags the arrival by k minutes."""
    created = V.micros(F.col("ts")) - F.get_json_object("props", "$.k").cast("bigint") * 60000000
    arrived = table(spark, folder, "events").select("event_id", created.alias("created"))
    late = messages.late_rows(arrived, "event_id", "created")
    return late.select("event_id", "created", (F.col("latest_before") - F.col("created")).alias("late_by"))


@query("day_digest", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS records, count(DISTINCT user_id) AS people,
        sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS files FROM events GROUP BY 1, 2""")
def day_digest(spark, folder):
    records = table(spark, folder, "events").withColumnRenamed("event_type", "kind")
    files = F.get_json_object("props", "$.k").cast("bigint")
    return digest.day_summary(records, _day(), F.col("user_id"), files, ["kind"])


@query("day_people", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS person, count(*) AS records FROM events GROUP BY 1, 2""")
def day_people(spark, folder):
    return digest.day_people(table(spark, folder, "events"), _day(), F.col("user_id"))


@query("record_ids", """
    SELECT event_id, 'lark-' || row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) AS id FROM events""")
def record_ids(spark, folder):
    records = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return digest.numbered_records(records, "lark", ["day"], ["event_id"], F.floor(F.col("event_id") / ROWS_PER_BLOCK)).select("event_id", "id")


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("day_page", f"""
    WITH body AS (SELECT conv_id AS day, role AS person, 2 AS part, turn AS place, '<article><h3>turn ' || turn || ' | ' || role || '</h3><p>'
        || {_ESC.format('text')} || '</p></article>' AS html FROM conversations),
    people AS (SELECT DISTINCT day, person FROM body), days AS (SELECT DISTINCT day FROM people)
    SELECT day, part::BIGINT AS part, place, html FROM body
    UNION ALL SELECT day, 1, 0, '<section><h2>' || person || '</h2>' FROM people
    UNION ALL SELECT day, 3, 0, '</section>' FROM people
    UNION ALL SELECT day, 0, 0, '<!DOCTYPE html><html><body><h1>Chat Records ' || day || '</h1>' FROM days
    UNION ALL SELECT day, 4, 0, '</body></html>' FROM days""")
def day_page(spark, folder):
    records = table(spark, folder, "conversations")
    fragment = digest.record_fragment(F.concat(F.lit("turn "), F.col("turn")), F.col("role"), F.col("text"))
    page = digest.day_page(records, F.col("conv_id"), F.col("role"), F.col("turn"), fragment, "Chat Records")
    return page.select("day", F.col("part").cast("bigint").alias("part"), F.col("at").alias("place"), "html")


@query("session_activity", """
    WITH gaps AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM gaps)
    SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + 1800000000 AS ended, count(*) AS messages FROM numbered GROUP BY user_id, n""")
def session_activity(spark, folder):
    found = messages.sessions(table(spark, folder, "events"), "user_id", V.micros(F.col("ts")))
    return found.select("user_id", "started", "ended", "messages")


@query("json_props", """
    SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS compact FROM events""")
def json_props(spark, folder):
    parsed = F.from_json("props", "k BIGINT")
    return table(spark, folder, "events").select(
        "event_id", parsed["k"].alias("k"), F.to_json(F.struct("event_type", parsed["k"].alias("k"))).alias("compact")
    )


@query("epoch_times", """
    SELECT event_id, strftime(to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS from_seconds,
        strftime(to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS from_millis,
        strftime(ts, '%Y-%m-%d') AS day FROM events""")
def epoch_times(spark, folder):
    seconds, millis = F.floor(V.micros(F.col("ts")) / 1000000), F.floor(V.micros(F.col("ts")) / 1000)
    from_seconds = V.epoch_iso(seconds.cast("string"))
    return table(spark, folder, "events").select(
        "event_id", from_seconds.alias("from_seconds"), V.epoch_iso(millis.cast("string")).alias("from_millis"),
        V.date_prefix(from_seconds).alias("day"),
    )


@query("audit_counters", """
    SELECT event_type AS status, count(*) AS records, count(*) FILTER (value > 50) AS files, count(*) FILTER (event_type = 'error') AS errors,
        max(event_id) + 1 AS next_offset FROM events GROUP BY 1""")
def audit_counters(spark, folder):
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("status")).agg(
        F.count("*").alias("records"), F.count_if(F.col("value") > 50).alias("files"),
        F.count_if(F.col("event_type") == "error").alias("errors"), (F.max("event_id") + 1).alias("next_offset"),
    )


@query("allow_list", """
    WITH allowed AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100),
    ignored AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 150)
    SELECT event_id, user_id IN (SELECT user_id FROM ignored) AS ignored_sender FROM events WHERE user_id IN (SELECT user_id FROM allowed)""")
def allow_list(spark, folder):
    """Messages of allowed senders; ignored senders stay in, marked, as they count as processed."""
    events = table(spark, folder, "events")
    allowed = events.filter((F.col("event_type") == "purchase") & (F.col("value") > 100)).select("user_id").distinct()
    ignored = events.filter((F.col("event_type") == "error") & (F.col("value") > 150)).select("user_id").distinct()
    marked = events.join(allowed, "user_id", "left_semi").join(ignored.withColumn("hit", F.lit(True)), "user_id", "left")
    return marked.select("event_id", F.coalesce("hit", F.lit(False)).alias("ignored_sender"))


@query("retained_ids", """
    SELECT id FROM (SELECT DISTINCT event_id::VARCHAR AS id FROM events) ORDER BY id DESC LIMIT 5000""")
def retained_ids(spark, folder):
    return messages.retained_ids(table(spark, folder, "events").select(F.col("event_id").alias("id")), "id", rules.SEEN_LIMIT)


@query("append_once", """
    SELECT DISTINCT user_id AS session_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02')""")
def append_once(spark, folder):
    events = table(spark, folder, "events").select(F.col("user_id").alias("session_id"), "ts")
    log = events.filter(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz"))
    return digest.append_once(log, events, "session_id").select("session_id")


@query("person_folders", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'chat_' || c_custkey WHEN c_custkey % 3 = 1
        THEN trim(regexp_replace(c_name, '[^A-Za-z0-9._-]+', '_', 'g'), '._-') ELSE trim(regexp_replace(c_mktsegment || ' ' || c_custkey, '[^A-Za-z0-9._-]+', '_', 'g'), '._-') END AS person FROM customer""")
def person_folders(spark, folder):
    third = F.col("c_custkey") % 3
    label = V.person_label(
        F.when(third == 1, F.col("c_name")), F.when(third == 2, F.col("c_mktsegment")),
        F.when(third == 2, F.col("c_custkey").cast("string")), F.col("c_custkey"),
    )
    return table(spark, folder, "customer").select("c_custkey", label.alias("person"))


@query("mail_addresses", """
    SELECT s_suppkey, lower(s_name) || '@example.org' AS angled, lower(s_name) || '@example.org' AS bare FROM supplier""")
def mail_addresses(spark, folder):
    address = F.concat(F.col("s_name"), F.lit("@Example.org"))
    angled = F.concat(F.lit('"'), F.col("s_name"), F.lit(', Ltd" <'), address, F.lit(">, other@example.net"))
    return table(spark, folder, "supplier").select(
        "s_suppkey", V.first_address(angled).alias("angled"), V.first_address(address).alias("bare")
    )


@query("compact_records", """
    SELECT 'lark-' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, conv_id, role AS person, text FROM conversations""")
def compact_records(spark, folder):
    records = digest.numbered_records(
        table(spark, folder, "conversations"), "lark", ["conv_id"], ["turn"], F.floor(F.col("turn") / TEXTS_PER_BLOCK)
    ).select("id", F.col("conv_id").alias("time"), F.col("role").alias("person"), F.lit("chat").alias("kind"), "text")
    return digest.compact_records(records).select("id", F.col("time").alias("conv_id"), "person", "text")


@query("attachment_paths", """
    SELECT user_id, 'files/' || json_extract_string(props, '$.k') AS path, min(event_id) AS first FROM events
    WHERE event_type <> 'view' GROUP BY 1, 2""")
def attachment_paths(spark, folder):
    path = F.when(F.col("event_type") != "view", F.concat(F.lit("files/"), F.get_json_object("props", "$.k")))
    events = table(spark, folder, "events").withColumn("ordinal", F.col("event_id"))
    return digest.attachment_paths(events, path, ["user_id"])


@query("largest_variant", """
    SELECT user_id, max_by(event_id, value * 1000000 + event_id) AS file_id, max(value) AS file_size FROM events GROUP BY 1""")
def largest_variant(spark, folder):
    """value is a size; equal sizes go to the later one. Ids beyond 10,000 outweigh small differences of size."""
    sized = table(spark, folder, "events").select("user_id", F.col("event_id").alias("file_id"), F.col("value").alias("file_size"))
    return digest.largest_variant(sized, ["user_id"], F.col("file_size") * 1000000 + F.col("file_id"))
