"""Digest of one day of one channel: gate the records, place them in topics, write supplement pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase import rules, schemas
from lorebase.operators import digest, noise, snapshots, topics
from lorebase.operators.grouping import TEXTS_PER_BLOCK
from lorebase.session import persist_table


@dataclass
class DayDigest:
    gated: DataFrame
    covered: DataFrame
    supplements: DataFrame
    pages: DataFrame
    groups: DataFrame | None = None
    members: DataFrame | None = None
    content: DataFrame | None = None


def day_digest(records: DataFrame, pages: DataFrame, sections: DataFrame, channel: str, day: str,
               claims: DataFrame | None = None, decisions: DataFrame | None = None) -> DayDigest:
    """``records``: ordinal, kind, text and more of one day. ``pages``: section, title, records, first_record of the
    existing supplements. ``claims`` are the groups a classifier proposes (record_id, section, topic_title);
    without one every record goes to the unsorted section.
    """
    kinds = rules.DIGEST_KINDS.get(channel)
    wanted = records.filter(F.col("kind").isin(*kinds)) if kinds else records
    numbered = digest.numbered_records(
        wanted.withColumn("_day", F.lit(day)), channel, ["_day"], ["ordinal"], F.floor(F.col("ordinal") / TEXTS_PER_BLOCK)
    ).drop("_day").withColumnRenamed("id", "record_id")
    judged = numbered.withColumn("search_text", noise.record_text(numbered))
    gated = persist_table(noise.gate_records(judged, decisions, "record_id", "search_text"), "gated")
    kept = gated.filter("kept")
    none = records.sparkSession.createDataFrame([], "record_id STRING, section STRING, topic_title STRING")
    covered = topics.cover_records(claims if claims is not None else none, kept, sections, channel, day)
    supplements = topics.supplement_pages(covered, channel, day)
    left = topics.drop_channel_page(pages, f"{channel.title()} Records", day)
    return DayDigest(gated, covered, supplements, snapshots.upsert_by_title(left, supplements))


def day_content(digest_run: DayDigest, sections: DataFrame, channel: str, day: str, html: str, now: str,
                groups: DataFrame | None = None, members: DataFrame | None = None, attachments: Sequence[str] = ()) -> DayDigest:
    """The digest with its content: the groups a classifier distilled (group_id, section, topic_title, distilled; members
    group_id, record_id) made fit for the notebook, and their pages. Without a classifier all records are one unsorted group."""
    spark = digest_run.gated.sparkSession
    kept = digest_run.gated.filter("kept").withColumn("label", F.concat_ws(" ", "record_id", "kind"))
    if groups is None or members is None:
        groups = spark.createDataFrame([], f"group_id STRING, section STRING, topic_title STRING, distilled {schemas.DISTILLED}")
        members = spark.createDataFrame([], "group_id STRING, record_id STRING")
    found, held = topics.normalised_groups(groups, members, kept.select("record_id", "ordinal", "label", F.col("search_text").alias("text")), sections, channel, day, attachments)
    found, held = persist_table(found, "groups"), persist_table(held, "members")
    return replace(digest_run, groups=found, members=held, content=topics.content_pages(found, held, channel, day, html, now))
