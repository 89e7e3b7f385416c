"""A provider without a network: deterministic, for tests and as the fallback when a service fails."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np


@dataclass(frozen=True)
class OfflineProvider:
    """Hashed character trigrams as vectors, a score threshold as reranker, the top snippets as answer."""

    model: str = "offline-trigrams"
    dimensions: int = 512
    threshold: float = 0.2

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        vectors = np.zeros((len(texts), self.dimensions))
        for row, text in enumerate(texts):
            folded = text.casefold()
            grams = [zlib.crc32(folded[i : i + 3].encode("utf-8")) % self.dimensions for i in range(len(folded) - 2)]
            np.add.at(vectors[row], grams, 1.0)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return (vectors / np.where(norms == 0, 1.0, norms)).tolist()

    def rerank(self, question: str, candidates: list[dict[str, Any]], max_selected: int) -> list[str]:
        return [c["chunk_id"] for c in candidates if c["score"] >= self.threshold][:max_selected]

    def answer(self, question: str, evidence: list[dict[str, Any]]) -> str:
        return "\n".join(f"- {item['title']}: {item['snippet'][:160]}" for item in evidence)
