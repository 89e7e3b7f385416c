"""Question -> ranked candidates -> rerank -> evidence -> answer.

The scan and the top-k run on Spark; what reaches the driver are at most 24 candidates with their snippets.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions import terms as Q
from lorebase.operators import postings, search
from lorebase.providers.base import Provider
from lorebase.session import persist_table


@dataclass
class Answer:
    query: str
    answer: str = rules.UNKNOWN_ANSWER
    likely_done_before: str = "unknown"
    confidence: str = "low"
    top_score: float = 0.0
    evidence: list[dict[str, Any]] = field(default_factory=list)
    error: str = ""


def candidates(index: DataFrame | postings.Blocks, question: str, provider: Provider | None, top_k: int = rules.CANDIDATES) -> tuple[DataFrame, str]:
    """Top candidates and the embedding error, if any: without a question vector the ranking is lexical only."""
    vector, error = None, ""
    if provider is not None:
        try:
            vector = provider.embed(["\n".join([question, *Q.aliases(question)])])[0]
        except Exception as failure:  # noqa: BLE001 - any failure of the service means lexical ranking
            error = f"{type(failure).__name__}: {failure}"
    top_k = max(rules.CANDIDATES_MIN, top_k)
    ranked = index.rank(question, vector, top_k) if isinstance(index, postings.Blocks) else search.rank_chunks(index, question, vector, top_k)
    return search.with_snippet(ranked, question, rules.RERANK_SNIPPET), error


def ask(index: DataFrame | postings.Blocks, question: str, provider: Provider, top_k: int = rules.DEFAULT_TOP_K) -> Answer:
    """The whole lifecycle for one question."""
    ranked, error = candidates(index, question, provider)
    found = persist_table(ranked.drop("vector"), "candidates")  # read twice below, scanned once
    shown = [row.asDict(recursive=True) for row in found.orderBy(F.desc("score"), F.desc("lexical_score"), F.desc("date"), "ordinal", "chunk_index").limit(rules.RERANK_WIDTH).collect()]
    if not shown:
        return Answer(question, error=error)
    wanted = set(provider.rerank(question, shown, max(1, min(top_k, rules.MAX_TOP_K))))
    selected = [item for item in shown if item["chunk_id"] in wanted]
    if not selected:
        return Answer(question, top_score=shown[0]["score"], error=error)
    reply = provider.answer(question, selected[: rules.ANSWER_WIDTH]).strip()
    if not reply:
        return Answer(question, error=error)
    ids = [item["chunk_id"] for item in selected]
    records = search.evidence(found.filter(F.col("chunk_id").isin(ids))).orderBy(F.desc("score"))
    evidence = [row.asDict() for row in records.collect()]
    return Answer(question, reply, "yes", "llm", evidence[0]["score"], evidence, error)


def render(answer: Answer) -> str:
    """Plain-text report of an answer."""
    lines = [f"Query: {answer.query}", f"Likely done before: {answer.likely_done_before}", "", "Answer:", answer.answer, "", "Evidence:"]
    for number, item in enumerate(answer.evidence, start=1):
        lines += [f"{number}. {item['section']} / {item['title']} (score {item['score']:.3f})", f"   Source: {item['html']}",
                  f"   Snippet: {item['source_snippet'][:500]}", ""]
    return "\n".join(lines + ([answer.error] if answer.error else [])).rstrip() + "\n"


def short_reply(evidence: list[dict[str, Any]], words: tuple[str, ...] = rules.REPLY_PRIORITY_WORDS, limit: int = 4) -> str:
    """Up to four bullets of the best page hit without a model: the first events, then items with a priority word, then
    the rest. ``evidence`` are at most a handful of ranked pages."""
    if not evidence:
        return rules.UNKNOWN_ANSWER
    happened, decided, facts = (evidence[0].get(k) or [] for k in ("what_happened", "decisions_or_conclusions", "important_facts"))
    everything = [*happened, *decided, *facts]
    urgent = [item for item in everything if any(word in item for word in words)]
    ordered = dict.fromkeys(text for item in [*happened[:2], *urgent, *everything] if (text := item.strip()))
    return "\n".join(f"- {item}" for item in list(ordered)[:limit]) or evidence[0].get("summary", "") or rules.UNKNOWN_ANSWER


def follow_up_question(previous: str, message: str) -> str:
    """Stand-alone question of a follow-up when no model rewrites it."""
    return f"{previous} {message}".strip()
