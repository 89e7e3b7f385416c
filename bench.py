"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lorebase.catalogue import QUERIES  # noqa: E402
from lorebase.session import build_session  # noqa: E402

HEADLINE = (
    "lexical_topk", "question_set_topk", "hybrid_topk", "semantic_topk", "page_field_rank", "memory_rank", "file_rank",
    "chunk_index", "vector_reuse", "export_chunks", "redact_documents", "normalize_text", "secret_scan", "local_distillation",
    "section_rollup", "html_text_index", "html_text_distiller", "page_meta", "page_links", "snapshot_diff", "upsert_or_key",
    "noise_gate_digest", "topic_groups_coverage", "doc_budget", "dedupe_messages", "mode_machine", "late_reorder",
    "day_digest", "session_activity", "stream_dedupe_replay", "stream_modes_replay",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = build_session("bench", f"local[{cpus}]", int(cpus), os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        timings = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            timings.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(timings[1:]), 3)
        print(f"{name}: first {timings[0]:.2f} then {seconds[name]:.2f}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
