"""Empty tables, and the parts of the operators that need cases of their own."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lorebase.llm import QUERIES, decontam, packing, partenum, quality, repair, tokens
from tests.llm.conftest import prose


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_samples_of_long_texts_come_from_words_by_weight(spark):
    """20,000 distinct words, half of them with weight 8: against the heavy half alone the samples agree in 8 of 9."""
    from lorebase.llm import cws

    rows = []
    for i in range(8):
        heavy = " ".join(f"h{i}x{j}" for j in range(10_000))
        light = " ".join(f"l{i}x{j}" for j in range(10_000))
        rows += [(i, "a", " ".join([heavy] * 8 + [light])), (i, "b", " ".join([heavy] * 8))]
    prints = cws.fingerprints(spark.createDataFrame(rows, "i INT, side STRING, text STRING").repartition(4), ["i", "side"]).collect()
    sides = {(r["i"], r["side"]): np.array(r["samples"]) for r in prints}
    assert abs(np.mean([sides[i, "a"] == sides[i, "b"] for i in range(8)]) - 8 / 9) < 0.04


def test_packing_plan_covers_the_counts_and_never_overfills():
    rng = random.Random(1)
    for _ in range(30):
        size = rng.choice((10, 64, 2048))
        counts = {rng.randint(1, size): rng.randint(1, 400) for _ in range(rng.randint(1, 60))}
        used = dict.fromkeys(counts, 0)
        plan = packing.best_two_fit(counts, size)
        for filling, times in plan:
            assert sum(length * n for length, n in filling.items()) <= size and times > 0
            for length, n in filling.items():
                used[length] += n * times
        assert used == counts


def test_two_pieces_replace_the_shortest():
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [({6: 1, 2: 2}, 1), ({3: 1}, 1)]


def test_packed_sequences_hold_the_ids(spark, folder):
    from lorebase.llm.tokens import vocabulary

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    packed = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), size=512)
    pieces = {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in packed.where("doc_id > 20 and doc_id < 120").collect()}
    for row in packing.sequences(packed).collect():
        for d in row["documents"]:
            if (d["doc_id"], d["start"]) in pieces:
                assert bytes(row["ids"])[4 * d["offset"]:4 * (d["offset"] + d["length"])] == pieces[d["doc_id"], d["start"]]


def test_grammar_round_trip_and_gain():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 500, rng.integers(1, 6)) for _ in range(300)]
    ids = np.concatenate([words[i] for i in rng.integers(0, 300, 20000)] + [np.zeros(999, np.int64)])
    borders = np.unique(np.concatenate([[0, len(ids)], rng.integers(0, len(ids), 200)]))
    short, places, rules, lengths = repair.compress(ids, borders, 500)
    grammar = repair.Grammar(rules, lengths, 500)
    assert (grammar.expand(short) == ids).all() and len(short) < 0.6 * len(ids)
    for a, b, x, y in zip(borders, borders[1:], places, places[1:], strict=False):
        assert (grammar.expand(short[x:y]) == ids[a:b]).all()


def test_one_document_is_read_from_its_slice(spark, folder, tmp_path, rows):
    from lorebase.llm.tokens import WordEncoder, vocabulary

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = str(tmp_path / "shards")
    repair.write_shards(repair.encode_shards(docs, vocabulary("byte_bpe_50k.json"), 50_257, shard_ids=3000), path)
    assert repair.read_shards(spark, path).count() > 5
    text = next(r[1] for r in rows if r[0] == 203)
    want = WordEncoder(vocabulary("byte_bpe_50k.json"), True).encode([text])[0] + bytes(4)
    assert [bytes(r["ids"]) for r in repair.read_document(spark, path, 203).collect()] == [want]


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 1 << 62, n, dtype=np.uint64) * np.uint64(4) + rng.integers(0, 4, n, dtype=np.uint64)
        common = a[:max(1, int(np.ceil(n * 0.75)))] if rng.random() < 0.5 else a[:max(1, n - int(rng.integers(0, n // 4 + 1)))]
        extra = int(len(common) / 0.75 - n)
        b = np.concatenate([common, rng.integers(0, 1 << 62, max(0, int(rng.integers(0, extra + 1)) if extra > 0 else 0), dtype=np.uint64) * np.uint64(4) + np.uint64(1)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            sign, owner = partenum.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert set(sign[owner == 0].tolist()) & set(sign[owner == 1].tolist()), (len(a), len(b), both)


def test_near_duplicate_groups_over_small_blocks(spark):
    """Groups whose members link only along chains, blocks of two, cells of a few signatures: no link may be lost."""
    from tests.llm.test_results import linked, shingles

    rng = random.Random(11)
    rows, base = [], prose(rng, 120).split(" ")
    for i in range(60):
        if i % 15 == 0:
            base = prose(rng, rng.choice((8, 30, 120))).split(" ")
        base = list(base)
        base[rng.randrange(len(base))] = f"w{i}"
        rows.append((i, " ".join(base)))
    out = partenum.near_duplicates(spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3), cell_entries=500, block=2).collect()
    roots = linked([shingles(t) for _, t in rows])
    least = {}
    for (i, _), root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, i), i)
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: least[root] for (i, _), root in zip(rows, roots, strict=True)}


def test_wide_bitmaps_bound_the_distance_of_large_sets():
    """Unrelated sets of 1500 shingles are beyond what 512 bits tell apart; no bound exceeds the distance, over sizes that fold."""
    rng = np.random.default_rng(6)
    whole = rng.integers(0, 1 << 63, 9000, dtype=np.uint64)
    sets = [rng.permutation(whole[:n + 150])[:n] for n in (500, 600, 900, 1020, 1030, 1500, 2040, 2060)] + [whole[4000:5500], whole[6000:7500]]
    wide = partenum._Wide(pa.array([partenum._wide_bitmap(s) if len(s) > 512 else None for s in sets], pa.binary()))
    for x, a in enumerate(sets):
        for y, b in enumerate(sets):
            if 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)):
                assert wide.apart(np.array([x]), wide, np.array([y]))[0] <= len(np.setxor1d(a, b))
    assert wide.apart(np.array([8]), wide, np.array([9]))[0] * 175 > 3000 * 25


def test_open_pairs_of_a_large_group_are_linked_in_clusters(spark):
    """A group in which few pairs link though all share signatures: rows stay fewer than members, clusters are cut, no link is lost."""
    from tests.llm.test_results import linked, shingles

    n, rng = 300, np.random.default_rng(4)
    columns = {"node": rng.permutation(n), "component": np.arange(n), "n_shingles": np.full(n, 100), **{f"s{j}": np.zeros(n, np.int64) for j in range(8)}}
    block = pa.array([[{**dict(zip(columns, map(int, r), strict=True)), "wide": None} for r in zip(*columns.values(), strict=True)]] * 5)
    fields = block.type.value_type
    block = block.cast(pa.list_(pa.struct([f if f.name != "wide" else pa.field("wide", pa.binary()) for f in fields])))
    out = pa.Table.from_batches(partenum._reach(75)(iter([pa.RecordBatch.from_arrays([block, block], names=["left", "right"])])))
    assert out.num_rows == n - 1 and set(out["b"].to_pylist()) == set(range(1, n))

    words = random.Random(12)
    base = prose(words, 90).split(" ")
    rows = []
    for i in range(70):
        own = list(base)
        for at in words.sample(range(0, len(own), 5), words.choice((1, 2, 3, 4))):
            own[at] = f"w{i}x{at}"
        rows.append((i, " ".join(own)))
    for most in (partenum.CLUSTER_SHINGLES, 400):
        found = partenum.near_duplicates(spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3), cell_entries=2000, cluster_shingles=most).collect()
        roots = linked([shingles(t) for _, t in rows])
        least = {}
        for (i, _), root in zip(rows, roots, strict=True):
            least[root] = min(least.get(root, i), i)
        assert len(least) > 1 and {r["doc_id"]: r["component_id"] for r in found} == {i: least[root] for (i, _), root in zip(rows, roots, strict=True)}


def test_components_of_long_chains(spark):
    from lorebase.operators.linking import components

    edges = [(i, i + 1) for i in range(0, 90)] + [(i + 1, i) for i in range(200, 230)] + [(300, 301), (300, 301), (5, 5)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert out == {**dict.fromkeys(range(91), 0), **dict.fromkeys(range(200, 231), 200), 300: 300, 301: 300}


def test_leaks_are_found_at_any_place_and_with_edits():
    rng = random.Random(2)
    items = [prose(rng, rng.randint(15, 70)) for _ in range(60)]
    index = decontam.Items(list(range(60)), items)
    texts, want = [], []
    for i, item in enumerate(items):
        words = item.split(" ")
        if i % 3 == 1:
            words = words[1:]  # cut at an end
        if i % 3 == 2:
            words[-1] = "otherword"
        texts.append(" ".join([prose(rng, rng.randint(0, 90)), " ".join(words).upper() if i % 2 else " ".join(words), prose(rng, rng.randint(0, 90))]))
        want.append(i)
    found = {(row, index.ids[item]) for row, item, *_ in index.leaks(pa.array(texts))}
    assert len(found & {(i, i) for i in want}) >= 59 and len(found) <= 60


def test_items_of_one_to_four_words_are_found_in_long_texts():
    from tests.llm.test_results import best_similarity, plain_words

    rng = random.Random(4)
    items = ["alone", "two words", "three word item", "item of four words", "absent", "words two"]
    texts = [" ".join([prose(rng, rng.randint(0, 60)), item, prose(rng, rng.randint(6, 60)), item]) for item in items[:4]] + ["two words", "alone", prose(rng, 40), "word"]
    index = decontam.Items(list(range(len(items))), items)
    found = {(row, index.ids[item]): value for row, item, *_, value in index.leaks(pa.array(texts))}
    pairs = {(i, j): best_similarity(plain_words(t), plain_words(x)) for i, t in enumerate(texts) for j, x in enumerate(items)}
    assert found == {k: v for k, v in pairs.items() if v >= 0.75} and len(found) == 6


def test_more_items_than_fit_one_group(spark, folder):
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: {(r["doc_id"], r["item_id"]) for r in df.collect()}
    assert key(decontam.find_leaks(docs, bench, group_bytes=500)) == key(decontam.find_leaks(docs, bench))


def test_discriminant_scores_by_log_density():
    rng = np.random.default_rng(0)
    model = quality.Discriminant(np.zeros(2), np.ones(2), [np.zeros(2), np.ones(2)], [np.eye(2), np.eye(2) * 2], [0.0, np.log(4)])
    x = rng.normal(size=(5, 2))
    log = lambda m, s: -0.5 * (((x - m) / s) ** 2).sum(1) - 2 * np.log(s)
    good, bad = log(1, 0.5), log(0, 1.0)
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(bad - good)))


def test_held_out_quality_and_languages_on_the_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    scored = [r for r in QUERIES["op9_quadratic_discriminant"](spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in scored]) > 0.95
    named = [r for r in QUERIES["op5_string_kernel_language"](spark, folder).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in named]) > 0.98


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_are_the_tokenizers_own(name, spaced):
    """Words put together at random from letters whose folding is odd, marks, stops and names of added tokens."""
    from tests.llm.test_results import tokenizer
    from lorebase.llm.tokens import WordEncoder, vocabulary

    rng, plain = random.Random(9), tokenizer(name)
    pieces = ["İ", "ı", "ß", "ẞ", "Ǆ", "ﬁ", "Σ", "ς", "é", "e\u0301", "a", "B", "zoo", "ŉ", "ΐ", "中", "한", "1", "'s", ".", ",", ";", "!", "?", ":", "-", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<", "|", "\u0307"]
    texts = ["a <|endoftext|> b", "x<|endoftext|>y", "İ.", "Straße İ! İİ, end"]
    for _ in range(3000):
        words = ["".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 6))]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\n\n", "  ", "\t"]) for w in words))
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    got = WordEncoder(vocabulary(name), spaced).encode(texts)
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_copies_are_learned_from_once(spark):
    """400 copies of a row and as many rows of one id and language count as what they are: one text each at most."""
    from lorebase.llm import langid

    rows = [(1, "hello there my friend", "en")] * 400 + [(2, f"some text {i} of one id", "en") for i in range(60)] + [(3, "guten tag mein freund", "de"), (None, "salut mon ami", "fr")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING").repartition(4)
    sent = []
    collect = type(docs).collect

    def counted(df):
        out = collect(df)
        sent.append(len(out))
        return out

    type(docs).collect = counted
    try:
        model = langid.fit(docs)
    finally:
        type(docs).collect = collect
    assert sent == [63] and model.names == ["de", "en", "fr"]


def test_words_are_learnt_in_few_calls():
    """At byte level all new words of a batch come joined, also those with digits or signs and after line ends; ids stay the tokenizer's."""
    from tokenizers import Tokenizer

    path = tokens.vocabulary("byte_bpe_50k.json")
    encoder = tokens.WordEncoder(path, True, 500)
    texts = [" ".join(f"a{n}b{n * 7} $x{n}% é{n}.. it's{n} \n" + f"w{n}!!\nnext{n}# z" for n in range(i, i + 40)).replace(" \n", "\n") for i in range(0, 400, 20)]
    texts += ["", " ", "\n", "a", " b12 ", "c3\n", "\nd4", "\n\ne5", "x  y1", "中文1 字2\n字3", "<|endoftext|> a1", None]
    asked = []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return once.encode_batch_fast(texts, **more)

    once, encoder.once = encoder.once, Counted()
    plain = Tokenizer.from_file(path)
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want and len(asked) < 10
    assert [encoder.encode([t])[0] for t in texts] == want  # with words forgotten in between


@pytest.mark.parametrize("turns", [0, 1, 16])
def test_frequent_pairs_are_those_of_a_sort(monkeypatch, turns):
    monkeypatch.setattr(repair, "_TURNS", turns)
    rng = np.random.default_rng(7)
    pairs = rng.zipf(1.4, 5000) % 300
    found, counts, where = repair._frequent(pairs, (pairs % 13).astype(np.int32), 20)
    values, times = np.unique(pairs, return_counts=True)
    assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == dict(zip(values[times >= 20].tolist(), times[times >= 20].tolist(), strict=True))
    assert (np.append(found, -1)[where] == np.where(np.isin(pairs, found), pairs, -1)).all()
    assert all(len(x) == 0 for x in repair._frequent(pairs[:0], pairs[:0].astype(np.int32), 20))
