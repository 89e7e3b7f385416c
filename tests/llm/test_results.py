"""Each query over small tables against a plain computation of the same result."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorebase.llm.tokens import vocabulary


def crc(data):
    return zlib.crc32(data)


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def packed_ids(ids):
    return np.array(ids, "<u4").tobytes()


def test_shards_hold_every_row_once_in_proportion(answers, rows):
    out = answers("op1")
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (i, len((t or "").encode()) + 1, crc((t or "").encode())) for i, t, *_ in rows)
    counts = Counter(r["shard"] for r in out)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(counts[shard]))
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in out)


def test_sources_are_spread_over_shards(spark, folder):
    from lorebase.llm.shard import interleave

    out = interleave(spark.read.parquet(f"{folder}/documents.parquet"), 8, block_rows=10).collect()
    total, each = Counter(r["source"] for r in out), Counter((r["source"], r["shard"]) for r in out)
    for source, n in total.items():
        shares = [each[source, s] for s in range(8)]
        assert max(shares) <= n / 8 + 2 and min(shares) >= n / 8 - 2


def test_packing_round_trip(answers, rows):
    encode = tokenizer("word_bpe_49k.json")
    want = Counter()
    for i, t, *_ in rows:
        ids = encode.encode(t or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at:at + 2048]
            want[i, n, at, len(own), crc(packed_ids(own))] += 1
    out = answers("op3")
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in out) // 2048) + 1


def test_token_shards_round_trip(answers, rows):
    encode, at, want = tokenizer("byte_bpe_50k.json"), 0, []
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = encode.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), crc(packed_ids(ids))))
        at += len(ids)
    assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in answers("op7")) == Counter(want)


def test_fingerprints(answers, rows):
    out = answers("op4")
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    ids = [i for i, _ in order]
    texts = {}
    for i, (doc_id, text) in enumerate(order):
        if ids.count(doc_id) == 1 and ids.count(ids[(i + 1) % len(order)]) == 1:
            following, half = order[(i + 1) % len(order)][1], len(text) // 2
            texts[doc_id] = text, text[:len(text) - half] + following[:half], following
    assert len(out) == len(rows)
    prints, errors = {}, []
    bag = lambda t: Counter(re.sub(r"[\n\r\t]", " ", t).split(" "))
    for r in out:
        if r["doc_id"] in texts:
            text, edited, following = texts[r["doc_id"]]
            assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
            for value, other in ((r["near_edited"], edited), (r["near_next"], following)):
                a, b = bag(text), bag(other)
                errors.append(value - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_languages(answers, rows):
    out = answers("op5")
    assert len(out) == len(rows)
    for r in out:
        assert r["held_out"] == (crc(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2) and 0 <= r["score"] <= 1
    named = {r["doc_id"]: r["lang_pred"] for r in out}
    assert named[200] == named[201] == named[202] == named[205] == "und" and named[203] in ("en", "fr")


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def linked(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def test_near_duplicates(answers, rows):
    sets = [shingles(r[1]) for r in rows]
    roots = linked(sets)
    least = {}
    for row, root in zip(rows, roots, strict=True):
        if row[0] is not None:
            least[root] = min(least.get(root, row[0]), row[0])
    want = Counter((r[0], len(s), least.get(root)) for r, s, root in zip(rows, sets, roots, strict=True))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in answers("op6")) == want


def test_secrets(answers, rows):
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = Counter()
    for i, text, *_ in rows:
        text = text or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        kinds = Counter(s[3] for s in spans)
        want[i, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(said.encode()).hexdigest()] += 1
    out = answers("op8")
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in out) == want


def test_ownership(spark):
    from lorebase.llm.secrets import masked, scan

    live, example = "Zk3Jq9Xw2Lm8Pv5Tb7Rc", "Ab3Jq9Xw2Lm8Pv5Tb7Zz"
    rows = [(1, f"mine {live} here", "a"), (2, f"again {live}", "a"), (3, f"x {example}", "a"), (4, f"y {example}", "b"), (5, f"z {example}", "c"),
            (6, "password=abc123abc123", "d"), (7, "bare abc123abc123 here", "d"), (8, "other zyx987zyx987 here", "d"), (9, "password=common99", "a"), (10, "password=common99", "b"), (11, "password=common99", "c")]
    out = {r["doc_id"]: r for r in scan(spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")).collect()}
    spans = {i: [(s["kind"], s["start"], s["end"], s["verdict"]) for s in r["spans"]] for i, r in out.items()}
    assert spans[1] == [("token", 5, 25, "live")] and spans[2] == [("token", 6, 26, "live")]
    assert not spans[3] and not spans[4] and not spans[8]
    assert spans[6] == [("assign", 0, 21, "live")] and spans[7] == [("token", 5, 17, "live")]
    assert spans[9] == [("assign", 0, 17, "example")]
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("éa SECRET b SECRET", [(3, 9), (5, 7), (12, 18)])], "text STRING, spans ARRAY<STRUCT<start: BIGINT, end: BIGINT>>")
    assert df.select(masked(F.col("text"), F.col("spans"), "#")).first()[0] == "éa # b #"


def test_many_secrets_in_one_text(spark):
    from lorebase.llm.secrets import scan

    text = " é".join(f"token={i:06d}x" for i in range(1500))
    found = scan(spark.createDataFrame([(1, text, "s")], "doc_id LONG, text STRING, source STRING")).first()["spans"]
    assert [(s["start"], s["end"]) for s in found] == [m.span() for m in re.finditer(r"token=\w+", text)]


def test_quality(answers, rows):
    out = answers("op9")
    assert len(out) == len(rows)
    for r in out:
        assert r["held_out"] == (crc(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def runs(words):
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def best_similarity(doc, item):
    n, want, best = len(item), runs(item), 0.0
    for at in range(max(1, len(doc) - n + 1)):
        own = runs(doc[at:at + n])
        both = sum((own & want).values())
        if both:
            best = max(best, both / (sum(own.values()) + sum(want.values()) - both))
    return best


def test_leaks(answers, rows, items):
    words = [(i, plain_words(t)) for i, t in items]
    want = {}
    for r in rows:
        doc = plain_words(r[1])
        for i, item in words:
            if item and doc and (value := best_similarity(doc, item)) >= 0.75:
                want[r[0], i] = value
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in answers("op10")}
    assert found.keys() == want.keys() and len(want) >= 12
    assert all(found[k] == pytest.approx(v) for k, v in want.items())


def test_replies(answers):
    out = [r for r in answers("op2") if r["conv_id"] is not None and r["conv_id"] < 6]
    for r in out:
        assert r["text"].startswith(f"turn {r['turn']} of thread {r['conv_id']}") and ">" not in r["text"]
        assert r["reply_to"] == (r["turn"] - 1 if r["turn"] else None) and (r["root"], r["depth"], r["place"]) == (0, r["turn"], r["turn"])
    assert [r["copies"] for r in out if r["conv_id"] == 0 and r["turn"] == 0] == [2]
    assert sum(r["copies"] for r in answers("op2")) == sum(1 + 3 * c for c in range(6)) + 4
