"""The registered queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import cws, decontam, langid, linededup, packing, partenum, quality, quotes, repair, resample, runs, secrets, shard
from lorebase.llm.common import table
from lorebase.llm.registry import query
from lorebase.llm.tokens import vocabulary
from lorebase.session import persist_table, shared_folder


@query("op1_interleaved_shards")
def op1_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.interleave(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_best_two_fit")
def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = persist_table(packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")), "pieces")
    return packing.pack(pieces.drop("ids")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op7_repair_shards")
def op7_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/repair-{uuid.uuid4().hex}"
    repair.write_shards(repair.encode_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 50_257), path)
    shards = repair.read_shards(spark, path)
    return repair.document_starts(shards, repair.decode_shards(shards, keep_ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32")


def _remainder(n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@query("op5_string_kernel_language")
def op5_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_remainder(4) != 2))
    return langid.predict(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op9_quadratic_discriminant")
def op9_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = persist_table(quality.with_statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(_remainder(3) != 1)
    score = quality.score_statistics(quality.fit(statistics, labels))
    return statistics.select("doc_id", (_remainder(3) == 1).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


@query("op8_ownership_frequency")
def op8_ownership_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "token")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda x: x["verdict"] == "live")).cast("long").alias("n_live"),
                        F.size(F.filter("spans", lambda x: x["verdict"] == "example")).cast("long").alias("n_example"))


@query("op4_weighted_sampling")
def op4_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    places = persist_table(cws.neighbours(docs), "places")
    texts = cws.with_edited(docs, places)
    versions = F.explode(F.array(F.struct(F.lit(0).alias("version"), "text"), F.struct(F.lit(1).alias("version"), F.col("edited").alias("text"))))
    prints = cws.fingerprints(texts.select("k", "r", versions.alias("v")).select("k", "r", "v.version", "v.text"), ["k", "r", "version"])
    own = prints.groupBy("k", "r").agg(F.max(F.when(F.col("version") == 0, F.col("samples"))).alias("own"), F.max(F.when(F.col("version") == 1, F.col("samples"))).alias("edit"))
    digests = texts.select("k", F.col("r").alias("_r"), F.sha2("edited", 256).alias("edited_sha256"))
    found = persist_table(own.join(digests, "k").where(cws.same("r", "_r")).select("r", "own", "edit", "edited_sha256"), "fingerprints")
    following = found.select(F.col("r").alias("next"), F.col("own").alias("following"))
    order = places.select("doc_id", "r", "n", "copies", F.col("last_r"))
    order = order.join(order.select(F.col("last_r").alias("_r"), F.col("r").alias("next")), F.col("r") == F.col("_r"))
    rows = found.join(order, "r").join(following, "next").withColumn("_copy", F.explode(F.expr("sequence(1, copies)")))
    return rows.select("doc_id", F.col("n").alias("n_chars"), "edited_sha256", cws.as_text(F.col("own")).alias("fingerprint"),
                       cws.as_text(F.col("edit")).alias("edited_fingerprint"), cws.likeness(F.col("own"), F.col("edit")).alias("near_edited"),
                       cws.likeness(F.col("own"), F.col("following")).alias("near_next"))


@query("op10_simhash_windows")
def op10_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LINKED = r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
    r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT d AS doc_id, min(c) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)"""


@query("op6_partenum_join", _LINKED)
def op6_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_quotation_links")
def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has turns without quotes, so they are first written as the mails in which people would have exchanged them."""
    return quotes.conversations(quotes.as_reply_mails(table(spark, sf_dir, "conversations"))).withColumnRenamed("thread", "conv_id").withColumnRenamed("own", "text")


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op11_line_keep_bitmaps", rf"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS n, unnest(lines) AS line FROM d),
    k AS (SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id""")
def op11_line_keep_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    return kept.select("doc_id", F.col("kept_n_lines").alias("n_lines"), F.col("kept_n_dropped").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_grammar_runs")
def op12_grammar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_importance_draw")
def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resample.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return resample.draw(scored).select("doc_id", "n_features", "weight", "score", "rank")
