"""Language identification by string kernels.

Texts are compared by a blended-spectrum kernel: how many different n-grams of one to four characters two texts share, over
the geometric mean of how many each has. Nyström landmarks, a bounded sample of texts of all languages, turn the kernel into
coordinates, and ridge regression on these, one against the rest, gives each language's score. The kernel is linear in the
hashed presence vectors, so landmarks, Nyström map and ridge weights multiply out once to one vector per language, and
texts are scored by batched products of presence matrix and weights.

Bounds: at most ``per_language`` texts of each language and ``most`` in all are learned from (ordered by a hash of the id),
``landmarks`` of these are landmarks; a text reaches the driver as 2**15 bits, whatever its length. Texts are read whole.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text when there is nothing to
learn from; rows with a null language are not learned from; repeated rows are predicted each; an empty table gives no
rows. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import mix, slices

GRAMS = 4
BITS = 15
SALTS = 64
PER_LANGUAGE, MOST, LANDMARKS, RIDGE, SHARPNESS = 300, 3000, 256, 1e-2, 6.0


def presence(texts: list[str | None], grams: int = GRAMS, bits: int = BITS) -> np.ndarray:
    """Which hashed n-grams of length 1 to ``grams`` each text has: one row of 0 and 1 per text."""
    out = np.zeros((len(texts), 1 << bits), np.float32)
    for row, text in zip(out, texts, strict=True):
        if text:
            codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            rolled = np.zeros(0, np.uint64)
            with np.errstate(over="ignore"):
                for n in range(1, min(grams, len(codes)) + 1):
                    rolled = codes.copy() if n == 1 else rolled[:-1] * np.uint64(0x100000001B3) + codes[n - 1:]
                    row[(mix(rolled + np.uint64(n << 40)) >> np.uint64(64 - bits)).astype(np.intp)] = 1
    return out


@dataclass
class Languages:
    names: list[str]
    weights: np.ndarray
    offset: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        named, score = ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and self.names and any(map(str.isalpha, t))]
        if known:
            x = presence([texts[i] for i in known])
            values = x @ self.weights / np.sqrt(x.sum(1, keepdims=True)) + self.offset
            best = values.argmax(1)
            likely = np.exp(SHARPNESS * (values - values.max(1, keepdims=True)))
            score[known] = 1 / likely.sum(1)
            for i, b in zip(known, best, strict=True):
                named[i] = self.names[b]
        return named, score


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST, landmarks: int = LANDMARKS, ridge: float = RIDGE,
        key: str = "doc_id", text: str = "text", lang: str = "lang") -> Languages:
    """Learns from the rows of ``docs`` whose language is not null."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    own = ["doc_id", "lang", "_digest"]
    rows = rows.withColumn("_digest", F.xxhash64("text"))
    order = ["_mix", "doc_id", "_digest"]
    first = Window.partitionBy("lang", "_salt").orderBy(*order)  # a language is spread over tasks first
    picked = rows.select(*own).distinct().select(*own, shuffled.alias("_mix"), F.pmod(F.xxhash64("doc_id", "_digest"), F.lit(SALTS)).alias("_salt"))  # copies count once
    picked = picked.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language)
    picked = picked.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_n") <= per_language)
    picked = picked.orderBy("_n", "lang").limit(most).select(*[F.col(c).alias(f"_{c}") for c in own], "_n")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("lang") == F.col("_lang")) & (F.col("_digest") == F.col("__digest"))
    chosen = rows.join(F.broadcast(picked), same)  # at most ``most`` rows

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch):
                packed = np.packbits(presence(few.column("text").to_pylist()).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([few.column("lang"), few.column("_n"), pa.array([p.tobytes() for p in packed], pa.binary())],
                                                 names=["lang", "_n", "bits"])

    found = chosen.select("lang", "_n", "text").mapInArrow(bits, "lang string, _n int, bits binary")
    found = found.groupBy("lang", "_n").agg(F.min("bits").alias("bits")).collect()  # of equal rows one, so at most ``most`` rows
    found.sort(key=lambda r: (r["_n"], r["lang"], r["bits"]))
    if not found:
        return Languages([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    names = sorted({r["lang"] for r in found})
    x = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in found), np.uint8).reshape(len(found), -1), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    y = np.array([[1.0 if r["lang"] == n else -1.0 for n in names] for r in found])
    marks = x[:landmarks]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    z = (x @ marks.T).astype(float) @ root
    centre, offset = z.mean(0), y.mean(0)
    w = np.linalg.solve((z - centre).T @ (z - centre) + ridge * len(z) / 10 * np.eye(z.shape[1]), (z - centre).T @ (y - offset))
    return Languages(names, (marks.T @ (root @ w)).astype(np.float32), offset - centre @ w)


def predict(docs: DataFrame, model: Languages, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                for at in range(0, some.num_rows, 128):
                    few = some.slice(at, 128)
                    named, score = model.predict(few.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([few.column("doc_id"), pa.array(named, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
