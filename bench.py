"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_RUNS
(default 3) are read from the environment.  Each query runs once to warm up, then
BENCH_RUNS times into a sink that consumes every row; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from passageworks.catalog.queries import QUERIES
from passageworks.session import build_session

HEADLINES = [
    "document_assembly",
    "constraint_report",
    "dense_turn_ids",
    "paragraphs",
    "sentences",
    "token_counts",
    "topic_labels",
    "sentence_chunks",
    "hybrid_chunks",
    "hash_embeddings",
    "chunk_table",
    "candidate_topk",
    "group_chunks_topk",
    "two_stage_retrieval",
    "text_retrieval",
    "ann_exact",
    "ann_few_probes",
    "two_stage_ann",
    "context_pack",
    "chat_requests",
    "response_audit",
    "answer_pipeline",
    "question_stream_answers",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINES:
        seen = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seen.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seen[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
