"""The stored index: hits of a full scan, from a few blocks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lorebase import schemas
from lorebase.operators import indexing, postings, search
from lorebase.plans import build_index
from lorebase.providers.offline import OfflineProvider

KEYS = ["chunk_id", "lexical_score", "semantic_score", "score"]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(600):
        text = " ".join(rng.choices(words, k=rng.randint(8, 60)))
        if i in (47, 48, 301, 599):
            text += " cavity finesse was high" + " cavity" * (i % 5)
        if i == 350:
            text += " 真空烘烤完成"
        rows.append((i, f"s{i}", "note", "Optics" if i % 97 == 0 else "Logs", "Finesse" if i == 200 else f"Note {i}", f"p{i}", text, "", "", {}))
    path = str(tmp_path_factory.mktemp("store") / "idx")
    build_index.build_index(spark, spark.createDataFrame(rows, schemas.SOURCE_DOC).repartition(5), path, "v1", OfflineProvider(), block_chunks=40)
    return build_index.open_index(spark, f"{path}/v1")


QUESTIONS = ["What finesse does the cavity have?", "真空烘烤", "optics log", "xyzzy", "ab note 301"]


@pytest.mark.parametrize("question", QUESTIONS)
def test_hits_are_those_of_a_scan(store, question):
    for k in (3, 40):
        want = [tuple(r) for r in search.rank_chunks(store.chunks, question, None, k).select(*KEYS).collect()]
        assert [tuple(r) for r in store.rank(question, None, k).select(*KEYS).collect()] == want
    vector = OfflineProvider().embed([question])[0]
    want = [tuple(r) for r in search.rank_chunks(store.chunks, question, vector, 10).select(*KEYS).collect()]
    assert [tuple(r) for r in store.rank(question, vector, 10).select(*KEYS).collect()] == want


def blocks_read(top):
    """The blocks that the scans of a plan are limited to."""
    plan = top._jdf.queryExecution().executedPlan().toString()
    return [{int(n) for n in re.findall(r"\d+", found)} for found in re.findall(r"PartitionFilters: \[[^\]]*block#\d+ (?:IN|INSET) \(?([\d, ]+)", plan)]


def test_only_candidate_blocks_are_read(store):
    assert store.chunks.select("block").distinct().count() == 15
    for read in blocks_read(store.rank("cavity finesse", None, 3)), blocks_read(store.rank("cavity finesse", OfflineProvider().embed(["cavity finesse was high cavity cavity"])[0], 3)):
        assert len(read) == 1 and {1, 14} <= read[0] and len(read[0]) < 8


def test_bounds_hold(store):
    for question in QUESTIONS:
        scored = search.rank_chunks(store.chunks, question, None, 600).groupBy("block").agg(F.max("lexical_score").alias("best"))
        for r in scored.join(store.bounds(question), "block", "left").collect():
            assert r["bound"] is not None and r["bound"] >= r["best"] - 1e-4


def test_many_blocks_are_joined(store, monkeypatch):
    monkeypatch.setattr(postings, "LISTED_BLOCKS", 2)
    want = [r["chunk_id"] for r in search.rank_chunks(store.chunks, "ab cavity", None, 10).collect()]
    assert [r["chunk_id"] for r in store.rank("ab cavity", None, 10).collect()] == want


def test_an_index_without_grams_is_scanned(spark, tmp_path):
    indexing.chunk_sources(spark.createDataFrame([(1, "s", "note", "A", "T", "p", "cavity finesse of the new mirrors", "", "", {})], schemas.SOURCE_DOC)).withColumn(
        "vector", F.lit(None).cast("array<float>")).write.parquet(str(tmp_path / "old"))
    found = build_index.open_index(spark, str(tmp_path / "old"))
    assert search.rank_chunks(found, "finesse").count() == 1
