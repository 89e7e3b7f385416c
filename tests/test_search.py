"""Question analysis, scores and rankers."""

import math

import pytest
from pyspark.sql import functions as F

from lorebase import rules, schemas
from lorebase.functions import scoring as S
from lorebase.functions import terms as Q
from lorebase.operators import search


def chunk_rows(spark, rows):
    base = dict(ordinal=0, chunk_id="", chunk_index=1, source_id="s", source_type="t", section="", title="", path="", date="",
                author="", source_hash="", text_hash="", text="", metadata={}, vector=None)
    return spark.createDataFrame([{**base, **r, "ordinal": r.get("ordinal", i)} for i, r in enumerate(rows)], schemas.CHUNK)


def test_terms():
    assert Q.question_terms("a DDS-1 x 556nm C++") [:3] == ["dds-1", "556nm", "c++"]
    assert Q.question_terms("真空烤", ()) == ["真空", "空烤", "真空烤"]
    assert Q.question_terms("真x空", ()) == ["真空"]  # grams bridge what stands between
    assert Q.question_terms("我们的腔", ()) == []
    assert Q.page_question_terms("我们的腔") == ["腔"]
    assert Q.aliases("How was the bake of the 真空 chamber?") == ["真空烘烤 真空烤 bakeout baking heating tape 加热带"]
    assert Q.aliases("bake") == []
    assert Q.word_tokens("Laser 真空烘烤, test_1") == ["laser", "真空烘烤", "test_1"]
    assert Q.file_terms("请给我 Moku manual 一下") == ["moku"]


@pytest.mark.parametrize("keep", [False, True])
def test_terms_column_is_the_same(evaluate, keep):
    texts = ["a DDS-1 x 556nm C++ dds-1", "真空烘烤 laser 真空", "腔", "", "我们 MOKU:Pro v1.2"]
    ours = evaluate(lambda c: Q.terms_column(c, keep_single=keep), *texts)
    assert ours == [Q.question_terms(t, (), keep_single=keep) for t in texts]


def test_lexical_score_by_hand(spark):
    index = chunk_rows(spark, [
        {"chunk_id": "c", "title": "The Laser log", "text": "laser alignment; the laser drifts"},
        {"chunk_id": "none", "text": "unrelated"},
    ])
    hits = search.rank_chunks(index, "laser").collect()
    assert [h["chunk_id"] for h in hits] == ["c"]
    # phrase, three counts in title and text at 2.2, title bonus
    assert hits[0]["lexical_score"] == pytest.approx(12 + 3 * 2.2 + 4)
    assert hits[0]["score"] == pytest.approx(22.6 / 32.6, abs=1e-6)


def test_term_weights():
    assert [Q.term_weight(t) for t in ("dds", "laser", "真空", "真空烘烤")] == [1.6, 2.2, 0.95, 1.45]


def test_counts_are_capped_and_do_not_overlap(evaluate):
    assert evaluate(lambda c: S.occurrences(c, "aa"), "aaaa", "aaaaa", "b", "") == [2, 2, 0, 0]


def test_hybrid_order_and_missing_vectors(spark):
    index = chunk_rows(spark, [
        {"chunk_id": "both", "text": "laser", "vector": [1.0, 0.0]},
        {"chunk_id": "semantic", "text": "other", "vector": [1.0, 0.0]},
        {"chunk_id": "lexical", "text": "laser", "vector": None},
        {"chunk_id": "opposite", "text": "other", "vector": [-1.0, 0.0]},
        {"chunk_id": "short", "text": "other", "vector": [1.0]},
    ])
    hits = {h["chunk_id"]: h for h in search.rank_chunks(index, "laser", [2.0, 0.0]).collect()}
    lex = 12 + 2.2
    assert list(hits) == ["both", "semantic", "lexical"]
    assert hits["both"]["score"] == pytest.approx(0.68 + 0.32 * lex / (lex + 10), abs=1e-6)
    assert hits["lexical"]["score"] == pytest.approx(0.32 * lex / (lex + 10), abs=1e-6)


def test_ties_keep_newer_date_then_index_order(spark):
    index = chunk_rows(spark, [{"chunk_id": i, "text": "laser", "date": d} for i, d in (("a", "2026-01-01"), ("b", "2026-02-01"), ("c", "2026-01-01"))])
    assert [h["chunk_id"] for h in search.rank_chunks(index, "laser").collect()] == ["b", "a", "c"]


def test_cosine_matches_python(spark):
    vectors = [[0.1 * i, 1.0 - 0.05 * i, (-1.0) ** i] for i in range(20)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i INT, v ARRAY<FLOAT>")
    query = [0.3, 0.2, 0.9]
    got = [r[0] for r in df.orderBy("i").select(S.cosine(F.col("v"), query)).collect()]
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    assert got == pytest.approx([sum(a * b for a, b in zip(v, query)) / (norm(v) * norm(query)) for v in vectors], abs=1e-6)


def test_question_set_equals_single_questions(spark):
    index = chunk_rows(spark, [{"chunk_id": str(i), "text": f"laser {'cavity ' * (i % 5)} dds {i}"} for i in range(30)])
    questions = ["laser cavity", "dds 7"]
    many = search.rank_question_set(index, questions, top_k=5).collect()
    for number, question in enumerate(questions, start=1):
        single = [h["chunk_id"] for h in search.rank_chunks(index, question, top_k=5).collect()]
        assert [h["chunk_id"] for h in sorted(many, key=lambda h: h["rank"]) if h["question_no"] == number] == single


def test_snippet(evaluate):
    text = "x" * 700 + " needle " + "y" * 700
    shown = evaluate(lambda c: S.snippet(c, ["needle"], 90), text, "no hit " * 30)
    flat = text
    start = flat.index("needle") - 30
    assert shown == [flat[start:start + 90], ("no hit " * 30)[:90]]
    assert evaluate(S.memory_snippet, "a" * 300, "short") == ["a" * 217 + "...", "short"]


def test_bands(spark):
    df = spark.createDataFrame([(20.0,), (8.0,), (7.9,), (0.0,)], "s DOUBLE")
    got = [tuple(r) for r in df.select(S.likely_band(F.col("s")), S.confidence_band(F.col("s"))).collect()]
    assert got == [("yes", "high"), ("likely", "medium"), ("unknown", "low"), ("unknown", "low")]


def test_files(spark):
    records = spark.createDataFrame(
        [("2026-01-02", "moku notes", [("/a/moku.pdf", "Moku.pdf"), ("/a/x.txt", "")]), ("2026-01-03", "moku again", [("/b/moku.txt", "moku.txt")])],
        "created_at STRING, text STRING, files ARRAY<STRUCT<path STRING, file_name STRING>>",
    ).withColumn("files", F.transform("files", lambda f: F.struct(
        f["path"].alias("path"), f["file_name"].alias("file_name"), F.lit("").alias("mime_type"), F.lit("").alias("classification"), F.lit("").alias("text_preview"))))
    hits = search.rank_files(search.file_index(records), "发 moku pdf")
    assert [(h["path"], h["score"]) for h in hits.collect()] == [("/a/moku.pdf", 3), ("/b/moku.txt", 1), ("/a/x.txt", 1)]
    assert search.rank_files(search.file_index(records), "nothing").count() == 0


def test_page_fields_count_once(spark):
    page = ("s", "Laser", "p.html", "", "", "", ["laser.pdf"],
            ("laser laser", ["laser"], [], [], None, [], ["laser"], [], []))
    df = spark.createDataFrame([page], schemas.DISTILLED_PAGE).withColumn("ordinal", F.lit(1))
    hit = search.rank_pages(df, "laser", "ordinal").collect()[0]
    weights = rules.PAGE_FIELD_WEIGHTS
    assert hit["score"] == pytest.approx(12 + sum(weights[w] for w in ("title", "summary", "what_happened", "tags", "attachments")))
