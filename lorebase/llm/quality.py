"""Quality scores by a regularised quadratic discriminant.

Every text is reduced to a few transformed statistics of its bytes, words, word runs and lines. The moments of each class
are native sums over all labelled rows, so fitting needs no sample; each class covariance is shrunk towards a multiple of
the identity, and its Cholesky factor is kept with the model. A score is the logistic of the difference of the two
log-densities: their Mahalanobis distances, by the kept factors, and log-determinants.

Defined results: a null or empty text has zero statistics and is scored like any other; labels that are null are left out,
repeated labels of one document count as their rounded mean; without labelled rows of both classes every score is 0.5;
repeated rows are scored each; an empty table gives no rows. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import FOLDED_VALUES, SOLID, byte_values, bytes_of, shingle_hashes, slices, word_hashes

STATISTICS = ("log_bytes", "word_length", "upper", "symbols", "stops", "digits", "marks", "bars", "distinct_words", "distinct_runs",
              "distinct_lines", "line_rate")
SHRINKAGE = 0.1
_LINE = np.array([b != 10 for b in range(256)])
_VALUES = byte_values()
_CLASSES = [np.array([test(b) for b in range(256)], np.uint8) for test in (
    lambda b: b >= 128 or chr(b).isalpha(), lambda b: 65 <= b <= 90, lambda b: 33 <= b < 128 and not chr(b).isalnum() and chr(b) not in ".,!?|'-",
    lambda b: chr(b) in ".,", lambda b: 48 <= b <= 57, lambda b: chr(b) in "!?", lambda b: b == 124)]


def _distinct(hashes: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes, and how many different ones, each text has."""
    order = np.lexsort((hashes, texts))
    h, t = hashes[order], texts[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return np.bincount(texts, minlength=n), np.bincount(t[new], minlength=n)


def statistics_of(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    raw, starts = bytes_of(texts)
    n, size = len(texts), np.diff(starts).astype(float)
    sums = [np.diff(np.concatenate([[0], np.cumsum(c[raw], dtype=np.int64)])[starts]).astype(float) for c in _CLASSES]
    letters, upper, symbols, stops, digits, marks, bars = sums
    words, _, bounds = word_hashes(raw, starts, SOLID, FOLDED_VALUES)
    lines, _, line_bounds = word_hashes(raw, starts, _LINE, _VALUES)
    word_texts, line_texts = np.repeat(np.arange(n), np.diff(bounds)), np.repeat(np.arange(n), np.diff(line_bounds))
    n_words, kinds = _distinct(words, word_texts, n)
    n_runs, run_kinds = _distinct(*shingle_hashes(words, bounds, 3), n)
    n_lines, line_kinds = _distinct(lines, line_texts, n)
    per = lambda a, b: a / np.maximum(b, 1)
    return np.stack([
        np.log1p(size), np.log1p(per(size, n_words)), np.sqrt(per(upper, letters)), np.sqrt(per(symbols, n_words)), np.sqrt(per(stops, n_words)),
        np.sqrt(per(digits, size)), np.sqrt(per(marks, n_words)), np.sqrt(per(bars, n_words)), per(kinds, n_words) * np.log1p(n_words) / 5,
        per(run_kinds, n_runs), per(line_kinds, n_lines), np.log1p(per(20.0 * n_lines, n_words))], 1)


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and one column per statistic."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch):
                found = statistics_of(few.column("text"))
                yield pa.RecordBatch.from_arrays([few.column("doc_id"), *(pa.array(found[:, j]) for j in range(len(STATISTICS)))],
                                                 names=["doc_id", *STATISTICS])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass
class Discriminant:
    """Per class: mean, inverse Cholesky factor, log-density constant; over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(rows), 0.5)
        x = (rows - self.centre) / self.scale
        bad, good = (c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True))
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def fit(statistics: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From ``labels (doc_id, label)``; two rows of sums come to the driver."""
    d, names = len(STATISTICS), STATISTICS
    one = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg((F.avg(F.col("label").cast("double")) >= 0.5).alias("good"))
    sums = statistics.join(one, "doc_id").groupBy("good").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(names)],
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d)]).collect()
    found = {r["good"]: r for r in sums}
    if len(found) < 2:
        return Discriminant(np.zeros(d), np.ones(d), [], [], [])
    total = sum(r["n"] for r in sums)
    first = {g: np.array([r[f"s{i}"] for i in range(d)]) for g, r in found.items()}
    second = {g: np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) for g, r in found.items()}
    centre = sum(first.values()) / total
    scale = np.sqrt(np.maximum(np.diag(sum(second.values())) / total - centre ** 2, 1e-8))
    means, factors, constants = [], [], []
    for good in (False, True):
        n = found[good]["n"]
        mean = first[good] / n
        covariance = (second[good] / n - np.outer(mean, mean)) / np.outer(scale, scale)
        covariance = (1 - shrinkage) * covariance + shrinkage * max(np.trace(covariance) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(covariance + 1e-9 * np.eye(d))
        means.append((mean - centre) / scale)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(n / total) - np.log(np.diag(lower)).sum()))
    return Discriminant(centre, scale, means, factors, constants)


def score_statistics(model: Discriminant) -> Column:
    """The score as a column over a table of statistics."""
    @F.pandas_udf("double")
    def run(*columns):
        import pandas as pd

        return pd.Series(model.score(np.stack([c.to_numpy() for c in columns], 1)))

    return run(*STATISTICS)


def score_text(model: Discriminant, text: Column) -> Column:
    """The score as a column over whole texts; all other columns of a table stay in Spark."""
    @F.arrow_udf("double")
    def run(texts):
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [model.score(statistics_of(few.column("text"))) for few in slices(batch)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run(text)
