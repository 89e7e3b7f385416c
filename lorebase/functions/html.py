"""HTML to text with native regular expressions; only entity decoding needs Python.

Mark-up is turned into private-use marker characters first, so one scan of the page serves every later step.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Sequence
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorebase import rules
from lorebase.functions.text import compact, strip

# Quoted attribute values may hold '>'. Possessive quantifiers keep the match linear.
_REST_OF_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_COMMENT = r"(?s)<!--.*?-->|<![^>]*+>|<\?[^>]*+>"
_ANY_TAG = rf"</?[a-zA-Z]{_REST_OF_TAG}"
_LESS, _AMP, _CUT = "", "", ""


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda value: None if value is None else _html.unescape(value))


_CLOSED = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed(reference: re.Match) -> str:
    name = reference.group()
    return _html.unescape(name) if name[1] == "#" or name[1:] in html5 else name


@F.pandas_udf(StringType())
def _unescape_closed(text: pd.Series) -> pd.Series:
    return text.map(lambda value: None if value is None else _CLOSED.sub(_closed, value))


def decode_entities(text: Column, closed: bool = False) -> Column:
    """Only texts with an ampersand go to Python; the others pass as null and come back as they were.

    Parsers also decode ``&amp`` without its semicolon; with ``closed`` such remnants of a cut text stay as they are.
    """
    decode = _unescape_closed if closed else _unescape
    return F.coalesce(decode(F.when(F.contains(text, F.lit("&")), text)), text)


def _tag(names: Sequence[str]) -> str:
    return rf"(?i)<(?:{'|'.join(names)})(?=[\s/>]){_REST_OF_TAG}"


def attribute(tag_text: Column, name: str) -> Column:
    """Raw value of an attribute in the text of one tag; '' when missing."""
    pattern = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.concat(*[F.regexp_extract(tag_text, pattern, group) for group in (1, 2, 3)])


def tags(page: Column, name: str) -> Column:
    return F.regexp_extract_all(page, F.lit(_tag([name])), F.lit(0))


def _drop_elements(page: Column, names: Sequence[str]) -> Column:
    return F.regexp_replace(page, rf"(?is)<({'|'.join(names)})(?=[\s/>]){_REST_OF_TAG}.*?</\1\s*+>", "")


def _protect_raw_text(page: Column) -> Column:
    """Script and style bodies are text, not mark-up: hide their ``<`` and ``&``."""
    marked = F.regexp_replace(page, rf"(?i)(<(?:script|style)(?=[\s/>]){_REST_OF_TAG})", _CUT + "$1")
    body = r"(?is)^(<[^>]*+>)(.*?)(</(?:script|style)\s*+>.*)$"

    def protect(piece: Column) -> Column:
        hidden = F.translate(F.regexp_extract(piece, body, 2), "<&", _LESS + _AMP)
        return F.when(
            piece.rlike(body), F.concat(F.regexp_extract(piece, body, 1), hidden, F.regexp_extract(piece, body, 3))
        ).otherwise(piece)

    return F.array_join(F.transform(F.split(marked, _CUT), protect), "")


def _tidy(text: Column) -> Column:
    text = F.regexp_replace(F.replace(text, F.lit("\xa0"), F.lit(" ")), r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def _labelled(page: Column, tag: str, attr: str, label: str) -> Column:
    """Put ``label value`` lines where the tag stands, if the attribute is not blank."""
    value = rf"""(?is)<{tag}(?=\s)(?=[^>]*?\s{attr}\s*=\s*(?:"\s*([^"]*?\S[^"]*?)\s*"|'\s*([^']*?\S[^']*?)\s*')){_REST_OF_TAG}"""
    return F.regexp_replace(page, value, "\n" + label + " $1$2\n")


def _visible(page: Column, block: Sequence[str], skip: Sequence[str], image: str, attachment: str, closed: bool) -> Column:
    page = _drop_elements(page, skip) if skip else _protect_raw_text(page)
    page = F.regexp_replace(page, _COMMENT, "")
    page = _labelled(_labelled(page, "img", "alt", image), "embed", "src", attachment)
    page = F.regexp_replace(F.regexp_replace(page, _tag(block), "\n"), _ANY_TAG, "")
    text = decode_entities(page, closed)
    return _tidy(text if skip else F.translate(text, _LESS + _AMP, "<&"))


def text_for_index(page: Column, closed: bool = False) -> Column:
    """Chunk index: no script, style, head or noscript; headings to h4, section and article break lines."""
    return _visible(page, rules.INDEX_BLOCK_TAGS, rules.INDEX_SKIP_TAGS, "[image]", "[attachment]", closed)


def text_for_page_search(page: Column, closed: bool = False) -> Column:
    return _visible(page, rules.PAGE_BLOCK_TAGS, rules.PAGE_SKIP_TAGS, "[image]", "[attachment]", closed)


def text_for_distiller(page: Column, image_label: str = "[image]", closed: bool = False) -> Column:
    """Distillers read everything, script and style bodies and the title included."""
    return _visible(page, rules.PAGE_BLOCK_TAGS, (), image_label, "[embedded attachment]", closed)


def text_for_import(page: Column, closed: bool = False) -> Column:
    """Import: the non-blank runs of character data, one per line."""
    page = F.regexp_replace(F.regexp_replace(_protect_raw_text(page), _COMMENT, _CUT), _ANY_TAG, _CUT)
    text = F.translate(decode_entities(page, closed), _LESS + _AMP, "<&")
    return F.array_join(F.filter(F.transform(F.split(text, _CUT), strip), lambda run: run != ""), "\n")


def text_for_mail(page: Column, closed: bool = False) -> Column:
    """Mail bodies: every tag is a blank, closing block tags and br break lines."""
    page = F.regexp_replace(page, r"(?is)<(script|style).*?>.*?</\1>", " ")
    page = F.regexp_replace(page, r"(?i)<br\s*/?>", "\n")
    page = F.regexp_replace(page, r"(?i)</(p|div|li|tr|h[1-6])>", "\n")
    return _tidy(decode_entities(F.regexp_replace(page, r"<[^>]+>", " "), closed))


def attachments(page: Column) -> Column:
    """Sources of img and embed tags, in order, without repeats."""
    sources = F.transform(
        F.regexp_extract_all(page, F.lit(_tag(["img", "embed"])), F.lit(0)), lambda t: strip(attribute(t, "src"))
    )
    return F.array_distinct(F.filter(sources, lambda s: s != ""))


def links(page: Column) -> Column:
    """href values of anchors in document order."""
    return F.filter(F.transform(tags(page, "a"), lambda t: attribute(t, "href")), lambda h: h != "")


def title(page: Column, closed: bool = False) -> Column:
    return _tidy(decode_entities(F.regexp_extract(page, rf"(?is)<title(?=[\s/>]){_REST_OF_TAG}(.*?)</title\s*>", 1), closed))


def meta(page: Column) -> Column:
    """name -> content of the meta tags that have a name; the last one wins."""
    named = F.filter(
        F.transform(
            tags(page, "meta"),
            lambda t: F.struct(attribute(t, "name").alias("key"), attribute(t, "content").alias("value")),
        ),
        lambda e: e["key"] != "",
    )
    # bound once: the first of each key in reverse order is the last one of the page
    return F.aggregate(F.reverse(named), F.create_map().cast("map<string,string>"),
                       lambda seen, e: F.when(F.map_contains_key(seen, e["key"]), seen).otherwise(F.map_concat(seen, F.create_map(e["key"], e["value"]))))


def body_preview(page: Column, length: int = rules.MANIFEST_PREVIEW, closed: bool = False) -> Column:
    body = F.regexp_extract(page, rf"(?is)<body(?=[\s/>]){_REST_OF_TAG}(.*?)(?:</body\s*>|\z)", 1)
    body = F.regexp_replace(_drop_elements(body, rules.PAGE_SKIP_TAGS), _COMMENT, "")
    body = F.regexp_replace(F.regexp_replace(body, _tag(["br"]), "\n"), _ANY_TAG, "")
    return F.substring(compact(decode_entities(body, closed)), 1, length)
