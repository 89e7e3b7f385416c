"""Import of exported files and of mail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions.text import base_name
from lorebase.operators import indexing
from lorebase.sources.binaries import export_files, read_binaries

HASHES_PER_BLOCK = 1 << 43  # ordinals are 63-bit hashes here: a million blocks


def ingest_exports(spark: SparkSession, glob: str, day: str) -> tuple[DataFrame, DataFrame]:
    """(entries, failures) of the files under a glob. A file without text is a failure with its reason, not an error
    of the job."""
    files = export_files(read_binaries(spark, glob))
    ready = F.coalesce(F.trim("text"), F.lit("")) != ""
    hash16 = F.substring("sha256", 1, rules.ARCHIVE_HASH_HEX)
    name = base_name(F.col("path"))
    readable = files.filter(ready).select(
        F.abs(F.xxhash64("path")).alias("ordinal"), name.alias("name"), hash16.alias("source_hash"), "text",
        F.concat(F.lit("sources/"), indexing.archive_name(name, hash16, day)).alias("archived"),
    )
    reason = F.when(F.col("kind") == "unsupported", "unsupported file type").when(
        F.col("kind") == "pdf", "PDF extraction needs a PDF reader").otherwise("no text extracted")
    return indexing.export_entries(readable, day, HASHES_PER_BLOCK), files.filter(~ready).select("path", reason.alias("reason"))
