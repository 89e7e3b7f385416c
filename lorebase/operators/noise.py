"""Relevance gates for communication records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions.text import casefold, contains_any, matches_any


def hinted(folded: Column, hints: Sequence[str], word_boundary: bool = False) -> Column:
    """Hints count anywhere inside a word; ``word_boundary`` asks for whole words instead."""
    if not word_boundary:
        return contains_any(folded, hints)
    words = "|".join(h.replace(".", r"\.") for h in hints)
    return folded.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])")


def is_index_noise(text: Column, hints: Sequence[str] = rules.INDEX_HINTS, noise: Sequence[str] = rules.INDEX_NOISE,
                   word_boundary: bool = False) -> Column:
    """Index gate: a noise marker and no hint."""
    folded = casefold(text)
    return ~hinted(folded, hints, word_boundary) & contains_any(folded, noise)


def digest_noise_reason(
    text: Column, hints: Sequence[str] = rules.DIGEST_HINTS, otp: Sequence[str] = rules.OTP_PATTERNS,
    ads: Sequence[str] = rules.AD_PATTERNS,
) -> Column:
    """Digest gate: login codes whatever the hints, advertising only without a hint, else ''."""
    folded = casefold(text)
    return (
        F.when(matches_any(folded, otp), rules.OTP_REASON)
        .when(matches_any(folded, ads) & ~hinted(folded, hints), rules.AD_REASON)
        .otherwise("")
    )


def is_uncertain(text: Column, hints: Sequence[str] = rules.DIGEST_HINTS,
                 markers: Sequence[str] = rules.WEAK_NOISE) -> Column:
    folded = casefold(text)
    return ~hinted(folded, hints) & contains_any(folded, markers)


def record_text(records: DataFrame) -> Column:
    """What a record is judged by: its filled fields, then those of its attachments and files, a line each. Columns and
    attachment fields that a channel does not have are left out."""
    def filled(value: Column) -> Column:
        return F.nullif(value.cast("string"), F.lit(""))

    parts = [filled(F.col(c)) for c in ("sender", "subject", "text_preview", "text", "kind", "person") if c in records.columns]
    for name in ("attachments", "files"):
        if name in records.columns:
            fields = [f for f in ("filename", "name", "mime_type", "text_preview") if f in records.schema[name].dataType.elementType.fieldNames()]
            lines = F.flatten(F.transform(name, lambda item: F.array(*[filled(item[f]) for f in fields])))  # noqa: B023
            parts.append(F.nullif(F.array_join(F.coalesce(lines, F.array().cast("array<string>")), "\n"), F.lit("")))
    return F.concat_ws("\n", *parts)


def gate_records(records: DataFrame, decisions: DataFrame | None, key: str, text: str = "text",
                 hints: Sequence[str] = rules.DIGEST_HINTS, otp: Sequence[str] = rules.OTP_PATTERNS,
                 ads: Sequence[str] = rules.AD_PATTERNS, markers: Sequence[str] = rules.WEAK_NOISE) -> DataFrame:
    """Adds kept, reason, uncertain. Nothing is dropped: filter on ``kept``.

    ``decisions`` (key, keep, reason) come from an outside judge and count for uncertain records only; records
    without a decision are kept.
    """
    judged = records.select(
        "*", digest_noise_reason(F.col(text), hints, otp, ads).alias("_rule"),
        is_uncertain(F.col(text), hints, markers).alias("_weak"),
    )
    if decisions is None:
        judged = judged.withColumn("_keep", F.lit(None).cast("boolean")).withColumn("_why", F.lit(None).cast("string"))
    else:
        judged = judged.join(
            # one row per key: a skip wins over a keep, and has its own reason
            decisions.groupBy(key).agg(F.min("keep").alias("_keep"), F.min(F.when(~F.col("keep"), F.col("reason"))).alias("_why")), key, "left"
        )
    uncertain = F.col("_weak") & (F.col("_rule") == "")
    skipped = uncertain & (F.col("_keep") == F.lit(False))
    reason = F.when(F.col("_rule") != "", F.col("_rule")).when(skipped, F.coalesce("_why", F.lit("external_gate"))).otherwise("")
    return judged.withColumn("uncertain", uncertain).withColumn("reason", reason).withColumn(
        "kept", F.col("reason") == ""
    ).drop("_rule", "_weak", "_keep", "_why")
