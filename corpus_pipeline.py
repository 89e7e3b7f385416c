"""The corpus pipeline: documents in, packed training sequences out.

1. ``quality``: texts that the quadratic discriminant scores below one half go.
2. ``near_duplicates``: of each component of linked texts the document with the smallest id stays; where several of its texts
   have that id, one of them. Rows of one id and text count once. Rows without an id can't be named as a copy and stay.
3. ``decontamination``: documents that hold a benchmark item go.
4. ``secrets``: secrets that are not widely copied examples are masked; every document stays.
5. ``packing``: what is left becomes sequences of at most 2048 tokens; a row per piece.

Row by row decisions are columns over the text, so tables with further columns, nulls and repeated rows pass through whole.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import decontam, packing, partenum, quality, secrets
from lorebase.llm.common import table
from lorebase.llm.tokens import vocabulary
from lorebase.session import persist_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    labels = labels.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 != 1)
    model = quality.fit(quality.with_statistics(docs.join(labels, "doc_id", "left_semi")), labels)
    return docs.where(quality.score_text(model, F.col("text")) >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.withColumn("_digest", F.xxhash64("text"))
    first = partenum.near_duplicates(keyed, digest="_digest").where("doc_id = component_id")
    linked = first.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("x")).select("x.*")
    kept = linked.unionByName(first.where("component is null").select("doc_id", "digest")).distinct().withColumnRenamed("digest", "_digest")
    once = keyed.join(kept, ["doc_id", "_digest"], "left_semi").dropDuplicates(["doc_id", "_digest"])
    return once.select(docs.columns).unionByName(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.where(~decontam.leaks(F.col("text"), table(spark, sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = F.filter("spans", lambda x: x["verdict"] != "example")
    found = secrets.scan(docs).select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), spans.alias("_spans")).where("size(_spans) > 0").dropDuplicates(["_doc", "_digest"])
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_doc"]) & (F.xxhash64(docs["text"]) == found["_digest"]), "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(secrets.masked(F.col("text"), F.col("_spans")))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = persist_table(packing.token_pieces(docs, vocabulary("word_bpe_49k.json")), "pieces")
    return packing.pack(pieces.drop("ids"))


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("secrets", mask_secrets), ("packing", pack_sequences)]

# Tokenisers, learned scores and windows by Hamming distance are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
