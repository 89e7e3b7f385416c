"""Helpers shared by the training-data operators: text views for numpy, tables in the shared folder, ranks, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BATCH_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``most`` bytes of text each; a longer text is a slice of its own."""
    values = batch.column(column)
    if len(values) == 0:
        return
    offsets = offsets_of(values)
    start = 0
    while start < len(values):
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(len(values), max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def offsets_of(values: pa.Array) -> np.ndarray:
    """Byte offsets of the values, one more than there are values; nulls are empty."""
    kind = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    return np.frombuffer(values.buffers()[1], kind, len(values) + 1, values.offset * np.dtype(kind).itemsize).astype(np.int64)


def bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each text starts (and the last ends)."""
    if values.null_count:
        values = values.fill_null("")
    offsets = offsets_of(values)
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Powers of an odd multiplier and its inverse mod 2**64, made on demand.
_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n).bit_length())
        with np.errstate(over="ignore"):
            _POWERS["up"] = np.cumprod(np.full(size, _ODD, np.uint64))
            _POWERS["down"] = np.cumprod(np.full(size, pow(_ODD, -1, 1 << 64), np.uint64))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(raw: np.ndarray, starts: np.ndarray, letters: np.ndarray, values: np.ndarray):
    """64-bit hashes of the words of many texts at once.

    ``letters`` says for each byte whether it belongs to a word, ``values`` gives its 64-bit value (equal for bytes that
    count as equal). Returns the hashes, the first byte of each word, and for each text where its words start.
    Words never cross the border of two texts.
    """
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = letters[raw]
    begin = inside[1:] & ~inside[:-1]
    end = ~inside[1:] & inside[:-1]
    cuts = starts[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    cuts = cuts[inside[cuts + 1] & inside[cuts]]  # a word runs on from one text into the next
    begin[cuts] = True
    end[cuts] = True
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values[raw] * up[:len(raw)], out=total[1:])
        hashes = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return hashes, first, np.searchsorted(first, starts)


def byte_values(same: bytes = b"", as_: bytes = b"") -> np.ndarray:
    """A fixed 64-bit value per byte; the bytes of ``same`` get the values of those in ``as_``."""
    with np.errstate(over="ignore"):
        out = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    for a, b in zip(same, as_, strict=True):
        out[a] = out[b]
    return out


UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
FOLDED_VALUES = byte_values(UPPER, LOWER)
#: every byte but white space
SOLID = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
#: letters, digits and all bytes beyond ASCII
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words per text, and the text each belongs to; a shorter text is one run of its words."""
    counts = np.diff(bounds)
    with np.errstate(over="ignore"):
        n = len(words)
        rolled = np.zeros(max(0, n - width + 1), np.uint64)
        for j in range(width):
            rolled += words[j:j + len(rolled)] * np.uint64(pow(_ODD, j + 1, 1 << 64))
        long = np.flatnonzero(counts >= width)
        texts = np.repeat(long, counts[long] - width + 1)
        at = np.arange(len(texts)) - np.repeat(np.cumsum(counts[long] - width + 1) - (counts[long] - width + 1), counts[long] - width + 1)
        hashes = mix(rolled[at + bounds[texts]]) if len(texts) else np.zeros(0, np.uint64)
        short = np.flatnonzero((counts > 0) & (counts < width))
        whole = np.array([sum(int(words[bounds[i] + j]) * pow(_ODD, j + 1, 1 << 64) for j in range(counts[i])) + int(counts[i])
                          & (1 << 64) - 1 for i in short], np.uint64)
    return np.concatenate([hashes, mix(whole)]), np.concatenate([texts, short])


def summed_rank(df: DataFrame, keys: list[str], block: str, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds ``name``: the place of each row within ``keys``, by block and then by ``order``, from 0; and ``name_total``.

    Blocks of bounded size keep a hot key out of one task: rows are numbered within their block, and only one row per
    block crosses the window of the whole key. Keys may be null.
    """
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("_n").over(whole.orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, block])], before.alias("_before"),
                           F.sum("_n").over(whole).alias("_total"))
    numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, block).orderBy(*order)))
    on = F.lit(True)
    for i, k in enumerate([*keys, block]):
        on = on & numbered[k].eqNullSafe(counts[f"_k{i}"])
    return numbered.join(counts, on).select(*[numbered[c] for c in df.columns], (F.col("_before") + F.col("_rn") - 1).alias(name),
                                            F.col("_total").alias(f"{name}_total"))
