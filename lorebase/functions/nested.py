"""JSON values of any nesting: redacted in place, flattened to lines, or taken as a list.

A JSON text is a run of tokens, so its strings can be rewritten and its leaves listed token by token, however deep they lie:
one pass of built-in functions per row, no level-by-level unfolding and no shuffle. Escaped quotes and backslashes are put
out of the way first, so a token is found by a plain pattern. Input is valid JSON; null stays null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions.text import bind, redact

# Two characters that no text may hold stand for an escaped backslash and an escaped quote while tokens are cut.
_HELD = (("\\\\", "﷐"), ('\\"', "﷑"))
_ANY_TOKEN = r'"[^"]*+"\s*:|"[^"]*+"|[^"]++'
_LEAF_TOKEN = r'"[^"]*+"\s*:\s*null\b|"[^"]*+"\s*:|"[^"]*+"|[{}\[\]]|[^\s,:{}\[\]"]++'


def _held(value: Column) -> Column:
    for escaped, mark in _HELD:
        value = F.replace(value, F.lit(escaped), F.lit(mark))
    return value


def _released(value: Column) -> Column:
    for escaped, mark in reversed(_HELD):
        value = F.replace(value, F.lit(mark), F.lit(escaped))
    return value


def _tokens(value: Column, pattern: str) -> Column:
    return F.regexp_extract_all(_held(value), F.lit(pattern), F.lit(0))


def _unquoted(token: Column) -> Column:
    return F.get_json_object(F.concat(F.lit("["), _released(token), F.lit("]")), "$[0]")


def _is_string(token: Column) -> Column:
    return F.startswith(token, F.lit('"')) & F.endswith(token, F.lit('"'))


def redact_json(value: Column, rule_set: Sequence[tuple[str, str]] = rules.INDEX_REDACTION) -> Column:
    """The value with every string in it redacted, at any depth; keys, numbers and layout stay."""
    def one(token: Column) -> Column:
        def rewritten(text: Column) -> Column:
            new = redact(text, rule_set)
            quoted = F.to_json(F.array(new))
            return F.when(new == text, _released(token)).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))

        return F.when(_is_string(token), bind(_unquoted(token), rewritten)).otherwise(_released(token))

    return F.array_join(F.transform(_tokens(value, _ANY_TOKEN), one), "")


def flatten_json(value: Column) -> Column:
    """Lists as lines, objects as ``key: value`` lines, at any depth; nulls are left out. Numbers stay as they are written."""
    kept = F.filter(_tokens(value, _LEAF_TOKEN), lambda t: (t != "null") & ~(F.startswith(t, F.lit('"')) & F.endswith(t, F.lit("null"))))

    def piece(token: Column, before: Column) -> Column:
        opens = before.isin("", "[", "{") | F.endswith(before, F.lit(":"))
        line = F.when(opens | token.isin("]", "}"), F.lit("")).otherwise(F.lit("\n"))
        key = F.concat(_unquoted(F.regexp_replace(token, r"\s*:$", "")), F.lit(": "))
        text = (
            F.when(_is_string(token), _unquoted(token)).when(F.startswith(token, F.lit('"')), key).when(token.isin("[", "]", "{", "}"), F.lit(""))
            .when(token == "true", F.lit("True")).when(token == "false", F.lit("False")).otherwise(token)
        )
        return F.concat(line, text)

    def lines(tokens: Column) -> Column:
        before = F.concat(F.array(F.lit("")), F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))))
        return F.array_join(F.zip_with(tokens, F.slice(before, F.lit(1), F.size(tokens)), piece), "")

    return bind(kept, lines)


def list_json(value: Column) -> Column:
    """null is no element, a list its elements, an object its ``key: value`` lines, anything else one element; each flattened.

    Objects inside elements have their keys in alphabetical order.
    """
    parsed = F.try_parse_json(value)
    flat = lambda v: flatten_json(F.to_json(v))
    elements = F.transform(F.try_variant_get(parsed, "$", "array<variant>"), lambda v: F.when(F.is_variant_null(v), F.lit(None).cast("string")).otherwise(flat(v)))
    members = F.try_variant_get(parsed, "$", "map<string,variant>")
    lines = F.transform(F.map_keys(F.from_json(value, "map<string,string>")), lambda k: F.concat(
        k, F.lit(": "), F.when(F.is_variant_null(F.element_at(members, k)), F.lit("None")).otherwise(flat(F.element_at(members, k)))))
    start = F.substring(F.trim(value), 1, 1)
    return (
        F.when(value.isNull() | (F.trim(value) == "null"), F.array().cast("array<string>")).when(start == "[", elements).when(start == "{", lines)
        .otherwise(F.array(flatten_json(value)))
    )
