"""Times, addresses and file kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions.text import casefold, safe_name, strip, suffix


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")


def epoch_iso(value: Column) -> Column:
    """ISO time of epoch seconds, or of milliseconds when the number is over ten billion; '' if it is no number."""
    number = value.try_cast("bigint")
    seconds = F.when(number > rules.MILLIS_THRESHOLD, F.floor(number / 1000)).otherwise(number)
    return F.coalesce(iso(F.timestamp_seconds(seconds)), F.lit(""))


def date_prefix(value: Column, fallback: str = "") -> Column:
    """Leading yyyy-mm-dd of a time string."""
    found = F.regexp_extract(value, r"^\d{4}-\d{2}-\d{2}", 0)
    return F.when(found == "", F.lit(fallback)).otherwise(found)


def mail_time(value: Column) -> Column:
    """RFC 2822 date; the weekday is dropped first, as Spark does not parse it."""
    bare = F.regexp_replace(F.regexp_replace(strip(value), r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)$", "")
    return F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")),
    )


def target_day(day: str | None = None) -> Column:
    """The given day, else yesterday."""
    return F.lit(day).cast("date") if day else F.date_sub(F.current_date(), 1)


def first_address(value: Column) -> Column:
    """First mail address of a header, case-folded; the display name when there is no address.

    Quoted names may hold commas and brackets, so they are taken out before the header is cut at its first comma.
    """
    text = F.coalesce(value, F.lit(""))
    unquoted = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', "")
    first = F.substring_index(unquoted, ",", 1)
    angled = strip(F.regexp_extract(first, r"<([^<>]*)>", 1))
    plain = strip(F.substring_index(first, "<", 1))
    quoted = strip(F.regexp_extract(text, r'^\s*"((?:[^"\\]++|\\.)*+)"', 1))
    return casefold(F.when(angled != "", angled).when(plain != "", plain).otherwise(quoted))


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)


def person_label(username: Column, first: Column, last: Column, chat: Column) -> Column:
    """Folder name of a person: user name, else the full name, else ``chat_<id>``."""
    fallback = F.concat(F.lit("chat_"), chat.cast("string"))
    full = strip(F.concat_ws(" ", strip(F.coalesce(first, F.lit(""))), strip(F.coalesce(last, F.lit("")))))
    return F.when(F.coalesce(username, F.lit("")) != "", safe_name(username, fallback)).otherwise(safe_name(full, fallback))


def file_class(path: Column, mime: Column) -> Column:
    """pdf_text, text, image_metadata_only, binary_metadata_only or file_metadata_only, in this order."""
    ending, kind = suffix(path), F.coalesce(mime, F.lit(""))
    return (
        F.when((ending == ".pdf") | (kind == "application/pdf"), "pdf_text")
        .when(F.startswith(kind, F.lit("text/")) | ending.isin(*rules.TEXT_SUFFIXES), "text")
        .when(F.startswith(kind, F.lit("image/")) | ending.isin(*rules.IMAGE_SUFFIXES), "image_metadata_only")
        .when(ending.isin(*rules.BINARY_SUFFIXES), "binary_metadata_only")
        .otherwise("file_metadata_only")
    )


def extractor(path: Column) -> Column:
    """Which text extractor an exported file needs; null for unsupported kinds."""
    ending = suffix(path)
    return (
        F.when(ending.isin(*rules.EXPORT_TEXT_SUFFIXES), "text").when(ending.isin(".html", ".htm"), "html")
        .when(ending.isin(".mht", ".mhtml"), "mhtml").when(ending == ".docx", "docx").when(ending == ".pdf", "pdf")
    )
