"""Line dedup, periodic runs and importance resampling against plain computations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorebase.llm import linededup, resample, runs
from lorebase.llm.common import bytes_of, mix

FOLD = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def kept_texts(rows, min_docs, keep_first=False):
    """{(doc_id, text): (n_lines, dropped, kept)} of rows (doc_id, text)."""
    holders = defaultdict(set)
    spots = defaultdict(list)
    split = {(i, t or ""): (t or "").split("\n") for i, t in rows}
    key_of = lambda line: line.strip(" \t\n\v\f\r").translate(FOLD)
    for (i, t), lines in split.items():
        for n, line in enumerate(lines):
            holders[key_of(line)].add((i, t) if i is None else i)
            spots[key_of(line)].append(((i is not None, i or 0), i, t, n))
    out = {}
    for (i, t), lines in split.items():
        kept = []
        for n, line in enumerate(lines):
            common = key_of(line) and len(holders[key_of(line)]) >= min_docs
            if not common or (keep_first and min(spots[key_of(line)])[1:] == (i, t, n)):
                kept.append(line)
        out[i, t] = len(lines), len(lines) - len(kept), "\n".join(kept)
    return out


def line_rows():
    rng = random.Random(4)
    common = [f"License line {j}" for j in range(6)]
    rows = []
    for i in range(90):
        lines = [f"own {i} {rng.random()}" for _ in range(rng.randint(0, 5))]
        for j, line in enumerate(common):
            if i % (j + 1) == 0 and i < 60 - 8 * j:
                lines.insert(rng.randint(0, len(lines)), rng.choice((line, " \t" + line.upper() + "\r", line.lower())))
        if i % 7 == 0:
            lines += ["twice here", "", "twice here ", "  "]
        if i % 3 == 0:
            lines.insert(0, "a third of all")
        rows.append((i, "\n".join(lines)))
    rows += [(3, rows[3][1]), (3, "a third of all\nelse"), (None, "a third of all\nno id"), (None, "a third of all\nno id"), (None, None), (200, None), (201, ""), (202, "\n\n"), (203, "É\né\n" * 3)]
    return rows + [(300 + i, "x" + "only few" * (i < 9) + "\nten of them" * (i < 10)) for i in range(12)]


@pytest.mark.parametrize("parts", [3, 30])
def test_bitmaps_over_many_ranges(spark, parts):
    """Forty ranges over few keys: most keys span several ranges, and batches of five rows cut them again."""
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").withColumn("h1", F.lit("clash")).repartition(5)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for keep_first in (False, True):
            out = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs, keep_first=keep_first)).collect()
            assert Counter((r["doc_id"], r["kept_n_lines"], r["kept_n_dropped"], r["kept"]) for r in out) == Counter(
                (i, *kept_texts(rows, 10, keep_first)[i, t or ""]) for i, t in rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_every_line_once(spark):
    rows = [(i, "same\nother\nsame") for i in range(4)] + [(9, "new\nsame")]
    docs = spark.createDataFrame(rows, "doc_id STRING, text STRING")
    out = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs, min_docs=1, keep_first=True))
    assert {r["doc_id"]: r["kept"] for r in out.collect()} == {"0": "same\nother", "1": "", "2": "", "3": "", "9": "new"}


def test_line_query(answers, rows):
    want = kept_texts([(r[0], r[1]) for r in rows], 10)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in answers("op11")) == Counter(
        (r[0], *want[r[0], r[1] or ""][:2], sha(want[r[0], r[1] or ""][2])) for r in rows)


def plain_runs(words):
    """(start, length, period) by trying every period at every word."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def test_runs_of_random_words():
    rng = random.Random(1)

    def words():
        kinds = rng.choice((1, 2, 3, 5, 9, 30))
        out = [rng.randrange(kinds) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            at, unit = rng.randrange(len(out) + 1), [rng.randrange(kinds) for _ in range(rng.randint(1, 7))]
            out[at:at] = (unit * 9)[:rng.randint(1, 9 * len(unit))]
        return out

    for _ in range(250):
        docs = [words() for _ in range(rng.randint(1, 9))]
        docs += docs[:rng.randint(0, 2)]
        hashes = mix(np.array([x + 1 for d in docs for x in d], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        start, end, period = runs.find_runs(hashes, bounds)
        for d, low, high in zip(docs, bounds, bounds[1:], strict=False):
            own = (start >= low) & (start < high)
            assert list(zip((start - low)[own].tolist(), (end - start)[own].tolist(), period[own].tolist(), strict=True)) == plain_runs(d)


def test_runs_of_long_texts():
    n = 300_000
    for words, want in ((np.zeros(n), [(0, n, 1)]), (np.arange(n) % (n // 5), [(0, n, n // 5)]), (np.arange(n), [])):
        hashes = mix((words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        start, end, period = runs.find_runs(hashes, np.array([0, n]))
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == want


def test_run_query(answers, rows):
    out, want = Counter(), Counter()
    for r in answers("op12"):
        out[tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))] += 1
    for doc_id, text, *_ in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        n = len(words)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = plain_runs(words)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want[doc_id, len(found), s, length, q, length and 1000 * length // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)),
             sha(" ".join(w for i, w in enumerate(words) if i not in gone))] += 1
    assert out == want and sum(1 for r in out if r[1]) > 3


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def test_buckets_of_features(rows, monkeypatch):
    texts = [r[1] for r in rows] + ["É a B", "x" * 3000 + " y z", "A", "a\x00b C-d"]
    for chunk in (1 << 18, 50):
        monkeypatch.setattr(resample, "CHUNK_WORDS", chunk)
        flat, bounds, words = resample.bucket_features(*bytes_of(pa.array(texts)))
        for i, text in enumerate(texts):
            want, n = plain_features(text)
            assert sorted(flat[bounds[i]:bounds[i + 1]].tolist()) == sorted(want) and words[i] == n


def test_draw_query(answers, rows, items):
    corpus, target = Counter(), Counter()
    found = [plain_features(r[1]) for r in rows]
    for own, _ in found:
        corpus.update(own)
    for _, text in items:
        target.update(plain_features(text)[0])
    s, t = corpus.total(), target.total()
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * (s + 10000) / ((corpus[b] + 1) * (t + 10000)))) for b in corpus}
    scored = []
    for (doc_id, *_), (own, n) in zip(rows, found, strict=True):
        weight = sum(gain[b] for b in own)
        h = int(sha(f"42:{'' if doc_id is None else doc_id}")[:8], 16)
        scored.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    out = answers("op13")
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in out) == Counter(x[:4] for x in scored)
    able = sorted(((-x[3], x[0] is None, x[0] or 0) for x in scored if x[4] >= 20))
    drawn = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in out if r["rank"])
    assert [d[0] for d in drawn] == list(range(1, len(able) * 5 // 100 + 1)) and [d[1:] for d in drawn] == able[:len(drawn)]


def test_ranks_over_many_ranges(spark):
    rows = [(i if i % 50 else None, 20 + i % 3 - (i % 11 == 0) * 5, 1, 0, i // 100) for i in range(1000)]
    scored = spark.createDataFrame(rows, "doc_id LONG, n_words LONG, n_features LONG, weight LONG, score LONG").repartition(7)
    out = [r["doc_id"] for r in resample.draw(scored, percent=30).where("rank is not null").orderBy("rank").collect()]
    able = sorted((-r[4], r[0] is None, r[0] or 0) for r in rows if r[1] >= 20)
    assert out == [None if missing else i for _, missing, i in able[:len(able) * 30 // 100]]
