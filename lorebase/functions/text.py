"""Text helpers as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase import rules


# White space that is not a single blank. The look-ahead turns away almost every character at once.
_UNTIDY = rf"(?!{rules.PRINTABLE})(?:{rules.WIDE_SPACE}{rules.SPACE}*| {rules.SPACE}+)"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, where it is needed several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Both ends trimmed of every Unicode white-space character."""
    return F.btrim(text, F.lit(rules.SPACE_CHARS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(rules.SPACE_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(rules.SPACE_CHARS))


def compact(text: Column) -> Column:
    """White-space runs become one blank, ends are trimmed. Single blanks are not rewritten."""
    return F.trim(F.regexp_replace(text, _UNTIDY, " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def casefold(text: Column) -> Column:
    """Lower case plus the foldings that differ from it in practice: sharp s, final sigma, long s."""
    folded = F.lower(text)
    for letter, target in (("ß", "ss"), ("ς", "σ"), ("ſ", "s")):
        folded = F.replace(folded, F.lit(letter), F.lit(target))
    return folded


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    """True when any needle is a substring; an unrolled OR, so it stays inside generated code."""
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(text, F.lit(needle))
    return found


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | text.rlike(pattern)
    return found


def suspicious(text: Column) -> Column:
    """False for texts that no redaction rule can match: plain substring tests, cheap next to six patterns."""

    def has_clue(low: Column) -> Column:
        found = contains_any(low, rules.REDACTION_CLUES)
        for first, second in rules.REDACTION_CLUE_PAIRS:
            found = found | (F.contains(low, F.lit(first)) & F.contains(low, F.lit(second)))
        numbered = F.contains(low, F.lit(":")) & low.rlike(rules.REDACTION_NUMBER_CLUE)
        cjk = (F.octet_length(low) > F.length(low)) & contains_any(low, rules.REDACTION_CJK_CLUES)
        return found | numbered | cjk

    return bind(F.lower(text), has_clue)


def apply_rules(text: Column, rule_set: Sequence[tuple[str, str]]) -> Column:
    for pattern, replacement in rule_set:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def redact(text: Column, rule_set: Sequence[tuple[str, str]] = rules.INDEX_REDACTION) -> Column:
    """Apply the (pattern, replacement) rules in order, to the texts that can match one at all."""
    return F.when(suspicious(text), apply_rules(text, rule_set)).otherwise(text)


def redact_map(values: Column, rule_set: Sequence[tuple[str, str]] = rules.INDEX_REDACTION) -> Column:
    return F.transform_values(values, lambda _key, value: redact(value, rule_set))


def flatten_map(values: Column) -> Column:
    """``key: value`` lines of a string map; null values are left out."""
    entries = F.filter(F.map_entries(values), lambda entry: entry["value"].isNotNull())
    return F.array_join(F.transform(entries, lambda entry: F.concat(entry["key"], F.lit(": "), entry["value"])), "\n")


def flatten_list(values: Column) -> Column:
    """Array elements as lines; nulls are left out."""
    return F.coalesce(F.array_join(values, "\n"), F.lit(""))


def normalise_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalise_export(text: Column) -> Column:
    """Line ends unified, three or more line breaks become two, ends trimmed."""
    lines = normalise_newlines(text)
    many = F.contains(lines, F.lit("\n\n\n"))
    return strip(F.when(many, F.regexp_replace(lines, r"\n{3,}", "\n\n")).otherwise(lines))


def normalise_entry(text: Column) -> Column:
    """Heading marks dropped, white space collapsed."""
    return compact(F.regexp_replace(text, rf"#+{rules.SPACE}*", ""))


def sha256(text: Column, hex_chars: int | None = None) -> Column:
    digest = F.sha2(text, 256)
    return F.substring(digest, 1, hex_chars) if hex_chars else digest


def source_id(prefix: str, identity: Column, hex_chars: int) -> Column:
    return F.concat(F.lit(prefix + ":"), sha256(identity, hex_chars))


def chunk_id(source: Column, index: Column, text_hash: Column) -> Column:
    identity = F.concat_ws(":", source, index.cast("string"), text_hash)
    return F.concat(F.lit("chunk-"), sha256(identity, rules.CHUNK_ID_HEX))


def truncate_with_marker(text: Column, limit: int, marker: str) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def split_reply(text: Column, limit: int) -> Column:
    """Consecutive pieces of at most ``limit`` characters; an empty text gives one empty piece."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(limit))
    return F.transform(starts, lambda start: F.substring(text, start + 1, F.lit(limit)))


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def escape_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def quoted_list(values: Column) -> Column:
    """A bracketed list of double-quoted strings, back slashes turned into slashes."""
    quoted = F.transform(
        values, lambda v: F.concat(F.lit('"'), escape_quotes(F.replace(v, F.lit("\\"), F.lit("/"))), F.lit('"'))
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def json_object_text(reply: Column) -> Column:
    """The JSON object inside a model reply: code fences and chatter around it are dropped; '' without one."""
    return F.regexp_extract(reply, r"(?s)\{.*\}", 0)


# --- names ---------------------------------------------------------------------------------------------------
def _or_fallback(text: Column, fallback: Column | str) -> Column:
    return F.when(text == "", fallback if isinstance(fallback, Column) else F.lit(fallback)).otherwise(text)


def slug_import(value: Column, limit: int = 60) -> Column:
    """Dash slug of imported files: an empty slug becomes ``imported-note``."""
    slug = F.btrim(F.regexp_replace(F.lower(value), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "-"), F.lit("-"))
    return F.btrim(F.substring(_or_fallback(slug, "imported-note"), 1, limit), F.lit("-"))


def slug_page(value: Column, limit: int = 80) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(value), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "-"), F.lit("-"))
    return F.btrim(F.substring(_or_fallback(slug, "untitled"), 1, limit), F.lit("-"))


def slug_topic(value: Column, fallback: str = "general") -> Column:
    """Topic titles keep letters of every script, digits and ``.,+()-``."""
    cleaned = F.regexp_replace(compact(value), r"[^\p{L}\p{N}_\x{4e00}-\x{9fff} .,+()-]+", "_")
    return _or_fallback(F.substring(F.btrim(cleaned, F.lit(" ._-")), 1, 80), fallback)


def slug_mail(value: Column, fallback: str = "unknown") -> Column:
    slug = F.regexp_replace(F.lower(strip(value)), r"<[^>]+>", "")
    slug = F.btrim(F.regexp_replace(slug, r"[^a-z0-9._@+-]+", "_"), F.lit("._-"))
    return _or_fallback(F.substring(slug, 1, 80), fallback)


def safe_name(value: Column, fallback: Column | str = "unknown") -> Column:
    cleaned = F.btrim(
        F.regexp_replace(strip(value), r"[^A-Za-z0-9\x{4e00}-\x{9fff}._-]+", "_"), F.lit("._-")
    )
    return _or_fallback(F.substring(cleaned, 1, 80), fallback)


def safe_filename(value: Column, fallback: str) -> Column:
    """Last path segment with control characters and separators replaced."""
    path = F.rtrim(_or_fallback(F.coalesce(value, F.lit("")), fallback), F.lit("/"))
    name = strip(F.element_at(F.split(path, "/"), -1))
    name = F.btrim(F.regexp_replace(name, r"[\x00-\x1f/\\:]+", "_"), F.lit(" ."))
    return _or_fallback(F.substring(name, 1, 160), fallback)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Last extension with its dot, case-folded; '' when there is none or the name only starts with a dot."""
    return casefold(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]+$", "")


def url_path_quote(path: Column) -> Column:
    """Percent-encoding for relative links: blanks become %20; ``/``, ``#`` and ``%`` stay."""
    quoted = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    quoted = F.replace(F.replace(quoted, F.lit("%2F"), F.lit("/")), F.lit("%23"), F.lit("#"))
    quoted = F.replace(F.replace(quoted, F.lit("%25"), F.lit("%")), F.lit("%7E"), F.lit("~"))
    return F.replace(quoted, F.lit("*"), F.lit("%2A"))
