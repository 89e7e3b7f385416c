"""Command grammar and intent tests of chat messages, as ordered ``when`` chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions.text import casefold, contains_any, matches_any, strip


def _prefix_group(names: Sequence[str]) -> str:
    return "^(" + "|".join(names) + ")+"


def intent_text(text: Column, names: Sequence[str] = rules.ASSISTANT_NAMES) -> Column:
    """Case-folded text without blanks, punctuation and a leading address."""
    bare = F.regexp_replace(casefold(strip(text)), rules.INTENT_PUNCTUATION, "")
    return F.regexp_replace(bare, _prefix_group(names), "")


def is_help(text: Column, names: Sequence[str] = rules.ASSISTANT_NAMES) -> Column:
    folded = casefold(strip(text))
    bare = F.regexp_replace(folded, rules.HELP_PUNCTUATION, "")
    bare = F.regexp_replace(F.regexp_replace(bare, _prefix_group(names), ""), rules.HELP_FILLER, "")
    return folded.isin(*rules.HELP_EXACT) | bare.isin(*rules.HELP_PHRASES) | matches_any(folded, rules.HELP_PATTERNS)


def is_casual(text: Column, names: Sequence[str] = rules.ASSISTANT_NAMES,
              words: Sequence[str] = rules.CASUAL_WORDS) -> Column:
    return intent_text(text, names).isin(*words)


def is_lab_query(text: Column, markers: Sequence[str] = rules.LAB_QUERY_MARKERS) -> Column:
    return contains_any(casefold(text), markers)


def is_file_request(text: Column, words: Sequence[str] = rules.FILE_REQUEST_WORDS) -> Column:
    return contains_any(casefold(text), words)


def is_follow_up(text: Column, names: Sequence[str] = rules.ASSISTANT_NAMES,
                 markers: Sequence[str] = rules.FOLLOWUP_MARKERS) -> Column:
    """Short messages, middling ones with a marker, and English openers count as follow-ups."""
    bare = intent_text(text, names)
    size = F.length(bare)
    return (size > 0) & (
        (size <= rules.FOLLOWUP_SHORT)
        | ((size <= rules.FOLLOWUP_LONG) & contains_any(bare, markers))
        | strip(text).rlike(rules.FOLLOWUP_START)
    )


def note_body(text: Column, names: Sequence[str] = ()) -> Column:
    """What follows a note verb; '' when the message is no note request."""
    address = rf"(?:(?:{'|'.join(names)})[，, ]*)?" if names else ""
    patterns = (
        rf"(?i)^{address}(?:帮我)?(?:{rules.NOTE_VERBS}){rules.SPACE}*([^\n]+)\z",
        rf"(?i)^(?:please{rules.SPACE}+)?(?:{rules.NOTE_VERBS_EN}){rules.SPACE}+([^\n]+)\z",
    )
    clean = strip(text)
    bodies = [strip(F.regexp_extract(clean, p, 1)) for p in patterns]
    return F.coalesce(*[F.nullif(b, F.lit("")) for b in bodies], F.lit(""))


def chat_id(text: Column) -> Column:
    """First number of 6 to 15 digits; '' without one."""
    return F.regexp_extract(text, rules.CHAT_ID_PATTERN, 1)


def is_allow_request(text: Column) -> Column:
    return (chat_id(text) != "") & contains_any(casefold(text), rules.ALLOW_WORDS)


def _slash(folded: Column, stripped: Column, words: Sequence[tuple[str, bool]]) -> list[tuple[Column, str, Column]]:
    """(condition, command, body) for slash commands; the flag says whether the rest is a body."""
    return [
        (
            F.startswith(folded, F.lit("/" + word)), word,
            strip(F.substring(stripped, len(word) + 2, 1 << 30)) if with_body else F.lit(""),
        )
        for word, with_body in words
    ]


def parse_command(text: Column, channel: str = "telegram", names: Sequence[str] = rules.ASSISTANT_NAMES) -> Column:
    """struct(command, body). The push channel knows modes and the allow list, the polled one does not, and the
    two test for casual chat at different places."""
    stripped = strip(text)
    folded = casefold(stripped)
    note = note_body(stripped, names)
    query = (F.startswith(stripped, F.lit("查")), "ask", strip(F.substring(stripped, 2, 1 << 30)))
    remember = (
        stripped.rlike(rf"^记(?:{rules.SPACE}|[：:，,])"), "note",
        strip(F.regexp_replace(stripped, rf"^记(?:{rules.SPACE}|[：:，,])*", "")),
    )
    help_request = (is_help(stripped, names), "help", F.lit(""))
    noted = (note != "", "note", note)
    casual = (is_casual(stripped, names), "chat", stripped)
    if channel == "telegram":
        chain = [
            (folded.isin(*rules.RECORD_ON_WORDS), "record_on", F.lit("")),
            (folded.isin(*rules.RECORD_OFF_WORDS), "record_off", F.lit("")),
            *_slash(folded, stripped, [("ask", True), ("note", True), ("allow", True), ("help", False),
                                       ("start", False), ("id", False), ("status", False)]),
            help_request,
            (is_allow_request(stripped), "allow", chat_id(stripped)),
            casual, noted, query, remember,
        ]
    else:
        chain = [
            *_slash(folded, stripped, [("ask", True), ("note", True), ("help", False), ("id", False), ("status", False)]),
            help_request, noted, query, remember, casual,
        ]
    def parsed(command: str, body: Column) -> Column:
        return F.struct(F.lit(command).alias("command"), body.alias("body"))

    result = F.when(chain[0][0], parsed(chain[0][1], chain[0][2]))
    for condition, command, body in chain[1:]:
        result = result.when(condition, parsed(command, body))
    return result.otherwise(parsed("agent", stripped))


def route(text: Column, names: Sequence[str] = rules.ASSISTANT_NAMES) -> Column:
    """Action of free text: note, file search, else a memory query (also the fallback when no model answers)."""
    return F.when(note_body(text, names) != "", "note").when(is_file_request(text), "find_file").otherwise("query_notebook")


def should_reply(text: Column, chat_type: Column, mentioned: Column, only_when_mentioned: bool = True) -> Column:
    commanded = F.lit(False)
    for command in rules.REPLY_COMMANDS:
        commanded = commanded | F.startswith(strip(text), F.lit(command))
    return (chat_type == "p2p") | commanded | mentioned | F.lit(not only_when_mentioned)


def is_mentioned(mentions: Column, bot_id: str, names: Sequence[str]) -> Column:
    """True when a mention carries the bot's id or one of its names."""
    folded = [n.casefold() for n in names]
    return F.exists(
        F.coalesce(mentions, F.array().cast("array<struct<key:string,id:string,id_type:string,name:string>>")),
        lambda m: ((F.lit(bot_id) != "") & (m["id"] == bot_id)) | casefold(m["name"]).isin(*folded),
    )


def message_text(content: Column, message_type: Column, mentions: Column | None = None) -> Column:
    """Readable text of a polled message body (JSON).

    Text messages carry ``text``; posts a title and nested runs; others a name or whatever readable strings they
    hold. Keys at any depth are found with one pattern, in document order.
    """
    def value_of(key: str) -> Column:
        return F.coalesce(F.get_json_object(content, f"$.{key}"), F.lit(""))

    def strings(keys: Sequence[str]) -> Column:
        pairs = F.regexp_extract_all(content, F.lit(rf'"(?:{"|".join(keys)})"\s*:\s*("(?:[^"\\]|\\.)*+")'), F.lit(1))
        return F.transform(pairs, lambda v: F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v"))

    run_keys = ("text", "un_escape_text")
    post = strip(F.array_join(F.concat(F.array(value_of("title")), strings(run_keys)), "\n"))
    named = F.coalesce(*[F.nullif(value_of(k), F.lit("")) for k in ("text", "file_name", "image_key")], F.lit(""))
    other = F.when(named != "", named).otherwise(strip(F.array_join(strings(rules.READABLE_KEYS), "\n")))
    text = F.when(message_type == "text", value_of("text")).when(message_type == "post", post).otherwise(other)
    if mentions is not None:
        text = F.aggregate(
            F.coalesce(mentions, F.array().cast("array<struct<key:string,id:string,id_type:string,name:string>>")), text,
            lambda t, m: F.replace(
                F.replace(t, F.coalesce(m["key"], F.lit("")), F.lit("")),
                F.concat(F.lit("@"), F.coalesce(F.nullif(m["name"], F.lit("")), F.lit(""))), F.lit(""),
            ),
        )
    return strip(F.regexp_replace(text, r"[ \t]+", " "))


def file_items(content: Column, message_type: Column, message_id: Column) -> Column:
    """Array (empty or one item) of the file a polled message carries."""
    def value_of(key: str) -> Column:
        return F.nullif(F.coalesce(F.get_json_object(content, f"$.{key}"), F.lit("")), F.lit(""))

    def item(kind: Column, key: Column, name: Column, mime: Column, size: Column) -> Column:
        return F.array(F.struct(kind.alias("kind"), key.alias("file_key"), name.alias("file_name"),
                                mime.alias("mime_type"), size.alias("file_size")))

    nothing = F.array().cast("array<struct<kind:string,file_key:string,file_name:string,mime_type:string,file_size:bigint>>")
    size = value_of("file_size").cast("bigint")
    mime = F.coalesce(value_of("mime_type"), F.lit(""))
    image = item(message_type, value_of("image_key"), F.concat(F.lit("image_"), message_id, F.lit(".jpg")),
                 F.lit("image/jpeg"), F.lit(None).cast("bigint"))
    plain = item(message_type, value_of("file_key"), F.coalesce(value_of("file_name"), F.lit("lark_file")), mime, size)
    media = item(message_type, value_of("file_key"), F.coalesce(value_of("file_name"), message_type), mime, size)
    return (
        F.when((message_type == "image") & value_of("image_key").isNotNull(), image)
        .when((message_type == "file") & value_of("file_key").isNotNull(), plain)
        .when(message_type.isin("media", "audio") & value_of("file_key").isNotNull(), media)
        .otherwise(nothing)
    )
