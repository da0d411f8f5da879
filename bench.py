"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is written to the no-op sink, so all result rows are produced without reaching the
driver.  The reported time is the better of two runs after a session warm-up.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evidloom.plans import registry  # noqa: E402
from evidloom.session import build_session  # noqa: E402

HEADLINE = [
    "w1_bm25_top_k", "r3_set_cosine_top_k", "r4_hybrid_top_k", "r6_vector_top_k",
    "j10_embedding_neighbours", "j2_candidate_generation", "k1_reference_resolution_job",
    "k2_evidence_retrieval_job", "k3_parsing_quality_job", "a11_cohens_kappa", "a12_mean_jaccard",
    "a13_alpha_nominal", "a14_alpha_interval", "a16_confidence_rollup", "a17_latency_percentiles",
    "a26_cost_rollup", "j6_adjudication_merge", "j13_smallest_container", "k4_link_publication_job",
    "k6_release_evaluation_job", "w8_transition_check", "e4_continuous_status",
    "r8_vector_plus_lexical", "r10_candidate_fusion", "d6_supersession_check", "d9_split_leakage",
    "e5_lifecycle_machine", "e8_analysis_feed", "e9_feedback_intake",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    registry.load_all()
    spark = build_session("bench", cores=cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            registry.spark_callable(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
