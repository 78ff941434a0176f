"""Time the headline queries: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from glossaflow.sources.scratch import local_session  # noqa: E402
from workload import views  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "speech_chat_records", "text_chat_records", "two_step_records",
    "batch_predict", "prediction_job", "shard_fanout",
    "char_ngram_stats", "token_overlap", "token_counts",
    "chrf_corpus", "bleu_corpus", "hallucination_coverage",
    "entity_report", "intrinsic_report", "system_report",
    "jsonl_dir_scan", "cache_audit", "batch_concat",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Starts the JVM code paths and the Python workers; not timed.
    QUERIES["intrinsic_report"](spark, "/root/testdata/sf0.001").collect()
    # Stored once per application; timed by itself, so no query pays for it.
    began = time.perf_counter()
    for table in ("documents", "embeddings"):
        views.source(spark, folder, table)
    for mixed in (True, False):
        views.pairs(spark, folder, mixed)
    times = {"ingest": round(time.perf_counter() - began, 3)}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
