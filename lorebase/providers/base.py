"""The model calls a memory makes, behind one interface."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

BATCH = 10
DIMENSIONS = 512


class Provider(Protocol):
    """What a model provider offers. Objects must be picklable: calls run inside tasks."""

    model: str

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...

    def rerank(self, question: str, candidates: list[dict[str, Any]], max_selected: int) -> list[str]:
        """Ids of the candidates that answer the question; empty when none does."""

    def answer(self, question: str, evidence: list[dict[str, Any]]) -> str:
        """The reply, '' when the evidence does not answer the question."""


def embed_column(text: Column, provider: Provider) -> Column:
    """Vectors of a text column in calls of ten texts, rounded to six digits; null texts are not sent."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            wanted = batch.dropna()
            vectors: list[Any] = []
            for start in range(0, len(wanted), BATCH):
                vectors += provider.embed(list(wanted.iloc[start : start + BATCH]))
            rounded = pd.Series([np.round(np.asarray(v), 6).tolist() for v in vectors], index=wanted.index, dtype=object)
            yield rounded.reindex(batch.index).map(lambda v: v if isinstance(v, list) else None)

    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(embed, ArrayType(FloatType()))(text)
