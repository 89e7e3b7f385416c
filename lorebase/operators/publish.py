"""Publish gate: which files may leave, and why the others may not."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions.text import contains_any


def denied_path(path: Column, exact: Sequence[str], prefixes: Sequence[str], controlled: Sequence[str],
                exceptions: Sequence[str]) -> Column:
    def under(roots: Sequence[str]) -> Column:
        found = F.lit(False)
        for root in roots:
            found = found | F.startswith(path, F.lit(root))
        return found

    return (
        path.isin(*exact) | under(prefixes) | (under(controlled) & ~path.isin(*exceptions))
        | contains_any(F.lower(path), rules.PUBLISH_DENIED_NAME_PARTS)
    )


def has_secret(text: Column) -> Column:
    """A pattern is run only on texts with its clues: plain substring tests, cheap next to a pattern on megabytes of text."""
    found = F.lit(False)
    for pattern, clues, words in zip(rules.PUBLISH_SECRET_PATTERNS, rules.PUBLISH_SECRET_CLUES, rules.PUBLISH_SECRET_WORDS, strict=True):
        able = reduce(lambda a, b: a & b, [contains_any(text, group) for group in clues])
        if words:
            able = able & contains_any(F.lower(text), words)
        found = found | (able & text.rlike(pattern))
    return found


def publish_verdict(files: DataFrame, exact: Sequence[str] = (), prefixes: Sequence[str] = (),
                    controlled: Sequence[str] = (), exceptions: Sequence[str] = ()) -> DataFrame:
    """Adds ``problem``: '' for files that may be published. ``files``: path, size, text, and ``binary`` (a NUL
    byte near the start), for which the text is not searched; ``secret`` where it is known already."""
    secret = F.col("secret") if "secret" in files.columns else has_secret(F.col("text"))
    problem = (
        F.when(denied_path(F.col("path"), exact, prefixes, controlled, exceptions), "private path")
        .when(F.col("size") > rules.PUBLISH_MAX_BYTES, "file exceeds the size limit")
        .when(~F.col("binary") & secret, "possible embedded credential")
        .otherwise("")
    )
    return files.withColumn("problem", problem)
