"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores.  Every
query runs once to warm up and once timed, and writes its whole result to a sink
that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from policyloom.session import build_session  # noqa: E402
from policyloom.workload import registry  # noqa: E402

HEADLINE = (
    "page_stats", "sections_merged", "chunks_boundary", "foreign_documents", "dup_chunk_rate", "library_counts",
    "knn_topk", "rrf_fused", "document_bucket", "hybrid_reranked", "bucket_budget", "best_passages", "section_sample",
    "region_routing", "citation_check", "minimum_citations", "commitment_evidence", "coverage_ladder", "risk_priority",
    "confidence", "consistency_violations", "decision_analytics", "evidence_pairs", "retrieval_metrics", "rank_stability",
    "session_carry", "history_window", "rolling_rate", "latest_per_key",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "policyloom-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    seconds: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, warm, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
