"""The stages one after the other against plain computations on each stage's own input."""

import corpus_pipeline
from lorebase.session import persist_table
from tests.llm.test_results import best_similarity, linked, plain_words, shingles


def test_stages(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = persist_table(stage(spark, docs, folder), name)
        after = docs.collect()
        if name == "packing":
            assert len({r["doc_id"] for r in after}) == len({i for i, _ in before})
            break
        assert docs.columns == columns
        kept = [(r["doc_id"], r["text"]) for r in after]
        if name == "near_duplicates":
            roots = linked([shingles(t) for _, t in before])
            least = {}
            for (i, _), root in zip(before, roots, strict=True):
                if i is not None:
                    least[root] = min(least.get(root, i), i)
            want = {i for (i, _), root in zip(before, roots, strict=True) if i is not None and least[root] == i}
            assert {i for i, _ in kept if i is not None} == want
        elif name == "decontamination":
            assert set(kept) == {(i, t) for i, t in before if not any(x and plain_words(t) and best_similarity(plain_words(t), x) >= 0.75 for x in items)}
        elif name == "secrets":
            assert len(kept) == len(before)
            assert all((i, t) in before or "[secret]" in t for i, t in kept)
        else:
            assert set(kept) <= set(before)


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_whole_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 50


def test_repeated_ids_are_told_apart_by_their_texts(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(3, one), (7, one + " more"), (7, two), (7, three), (9, three + " more"), (7, two + " more"), (5, ""), (5, None), (7, two)]
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id LONG, text STRING"), "").collect()]
    pair = [x for x in kept if x[1] in (two, two + " more")]
    assert len(pair) == 1 and {x for x in kept if x not in pair} == {(3, one), (7, three), (5, ""), (5, None)} and len(kept) == 5
