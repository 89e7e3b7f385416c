"""Target-distribution importance resampling over hashed word n-grams.

Features are runs of one to three words; a feature's bucket is the CRC-32 of its bytes modulo the number of buckets. The
features of a block of text are slices of its normalised bytes; the distinct ones of equal length are laid side by side as a
two-dimensional byte array, and all their checksums move on one column at a time. Buckets are scattered back to the
documents and written, two bytes a feature, so the corpus is read once for both passes: counts of all buckets over all
documents, then each document's weight. A document's score is its weight plus Gumbel noise from its id, so the highest scores
are a draw without replacement in proportion to the weights.

What reaches the driver are the counts per bucket, as many as there are buckets. The draw numbers rows by range
partitions of the score; one row per partition crosses its window.

Defined results: a null or empty text has no features and weight 0; a null id takes part in the noise as the empty text and
comes last among ties; equal rows tie and are numbered in any order; an empty table gives no rows, an empty target counts as
no features. Only the id and the text are read, so further columns can't clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import ALNUM, FOLDED_VALUES, LOWER, UPPER, bytes_of, slices, word_hashes
from lorebase.session import persist_table

BUCKETS = 10_000
WIDTH = 3
SEED = 42
MIN_WORDS = 20
PERCENT = 5
SLICE_BYTES = 2 << 20
#: features start in so many words at a time, whatever the length of a document
CHUNK_WORDS = 1 << 18
#: longer features are few of a length; each is summed on its own
LONGEST = 1024

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[list(UPPER)] = list(LOWER)


def _crc_table() -> np.ndarray:
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & 1, np.uint32(0xEDB88320) ^ (rest >> 1), rest >> 1)
    return rest


_TABLE = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``data``: those of equal size as the rows of one array, updated column by column."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, cuts):
        if not len(group):
            continue
        size = int(sizes[group[0]])
        if size > LONGEST:
            for i in group.tolist():
                out[i] = zlib.crc32(data[starts[i]:starts[i] + size])
            continue
        rows = max(1, (1 << 22) // max(size, 1))
        for at in range(0, len(group), rows):
            own = group[at:at + rows]
            columns = data[starts[own][None, :] + np.arange(size)[:, None]]
            crc = np.full(len(own), 0xFFFFFFFF, np.uint32)
            for column in columns:
                crc = _TABLE[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
            out[own] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def bucket_features(raw: np.ndarray, starts: np.ndarray, buckets: int = BUCKETS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``buckets, bounds, words``: the bucket of every feature, text by text, where each text's begin, and its words."""
    hashes, first, bounds = word_hashes(raw, starts, ALNUM, FOLDED_VALUES)
    stops = np.flatnonzero(np.append(~ALNUM[raw], True))
    last = np.minimum(stops[np.searchsorted(stops, first)], np.repeat(starts[1:], np.diff(bounds)))
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(bounds))
    found, of = [], []
    for a in range(0, len(first), CHUNK_WORDS):
        b = min(len(first), a + CHUNK_WORDS)
        end = min(len(first), b + width - 1)
        size = (last - first)[a:end]
        place = np.concatenate([[0], np.cumsum(size + 1)])
        text = np.full(place[-1], 0x20, np.uint8)  # the words, one space after each
        letters = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(place[:-1], size) + letters] = _FOLD[raw[np.repeat(first[a:end], size) + letters]]
        keys, at, sizes = [], [], []
        for n in range(1, width + 1):
            starting = np.arange(min(b - a, max(0, end - a - n + 1)))
            starting = starting[owner[a + starting] == owner[a + starting + n - 1]]
            with np.errstate(over="ignore"):
                rolled = np.full(len(starting), n, np.uint64)
                for j in range(n):
                    rolled = (rolled ^ hashes[a + starting + j]) * np.uint64(0x9E3779B97F4A7C15)
                    rolled ^= rolled >> np.uint64(29)
            keys.append(rolled)
            at.append(starting)
            sizes.append(place[starting + n] - 1 - place[starting])
        _, chosen, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        begin, sizes = np.concatenate(at), np.concatenate(sizes)
        found.append((checksums(text, place[begin[chosen]], sizes[chosen]) % np.uint32(buckets)).astype(np.uint16)[back])
        of.append(owner[a + begin])
    flat = np.concatenate(found) if found else np.zeros(0, np.uint16)
    of = np.concatenate(of) if of else np.zeros(0, np.int64)
    order = np.argsort(of, kind="stable")
    return flat[order], np.searchsorted(of[order], np.arange(len(starts))), np.diff(bounds)


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_features, buckets``: every feature's bucket, two bytes each."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket is stored in two bytes")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch, most=SLICE_BYTES):
                flat, bounds, words = bucket_features(*bytes_of(few.column("text")), buckets, width)
                data = flat.astype("<u2")
                blobs = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer((2 * bounds).astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([few.column("doc_id"), pa.array(words.astype(np.int64)), pa.array(np.diff(bounds).astype(np.int64)), blobs.cast(pa.binary())],
                                                 names=["doc_id", "n_words", "n_features", "buckets"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, buckets binary")


def _rows(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, starts = bytes_of(blobs)
    return np.frombuffer(raw.tobytes(), "<u2"), starts // 2


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket; a task sends one row per bucket, and so does the sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_rows(batch.column("buckets"))[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the log of its share of the target over its share of the corpus, one added to each count, in thousandths."""
    s, t, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weight_of(buckets: Column, gain: np.ndarray) -> Column:
    @F.arrow_udf("long")
    def run(blobs: pa.Array) -> pa.Array:
        flat, starts = _rows(blobs)
        sums = np.concatenate([[0], np.cumsum(gain[flat])])
        return pa.array(sums[starts[1:]] - sums[starts[:-1]])

    return run(buckets)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Noise in thousandths from the first 32 bits of the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    unit = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(unit))).cast("long")


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... along falling scores for the drawn share of rows long enough, else null.

    Rows are sorted by ranges of the score. An id that Spark counts within each range numbers them; the ranges before are
    added from one small row per range.
    """
    able = scored.withColumn("_able", F.col("n_words") >= min_words)
    order = [F.desc("_able"), F.desc("score"), F.asc_nulls_last("doc_id")]
    ordered = persist_table(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    ordered = ordered.withColumn("_range", F.shiftright("_at", 33))
    ranges = ordered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_able").alias("_long"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_long").over(Window.partitionBy()).alias("_all"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    taken = F.col("_able") & (place <= F.expr(f"{percent} * _all div 100"))
    return ordered.join(ranges, "_range").select(*scored.columns, F.when(taken, place).cast("long").alias("rank"))


def importance(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS,
               width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document, against the texts of ``target``."""
    found = persist_table(features(docs, key, text, buckets, width), "features")
    aim = features(target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text")), buckets=buckets, width=width)
    gain = gains(bucket_counts(found, buckets), bucket_counts(aim, buckets))
    weighed = found.select("doc_id", "n_words", "n_features", weight_of(F.col("buckets"), gain).alias("weight"))
    return weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
