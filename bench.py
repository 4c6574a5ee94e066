"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
Each query is run to completion through the no-op sink (no collect), after a
small warm-up that starts the JVM and the Python workers.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textlab.plans import catalog  # noqa: E402
from textlab.session import build_session, drop_scratch  # noqa: E402

HEADLINE = [
    "vocab_top",            # V1-V3: tokenise, count, distributed ranking
    "encode_ids",           # V5: truncate, broadcast vocab join, pad
    "sentence_vectors",     # E7: ids -> vectors -> pooling -> norm
    "corpus_fingerprint",   # P1
    "distinct_texts",       # P2
    "text_analysis",        # N1-N6 over the derived parse table
    "label_align",          # L1-L6 with the rule labeller
    "cluster_metrics",      # Q-1..Q-4 exact (blocked O(n^2) silhouette)
    "knn_graph",            # C6 exact
    "kmeans_assign",        # C3
    "hdbscan_leaves",       # C6-C7
    "tag_job_clusters",     # L1-L9, E1, C3-C9, Q-*
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "4g"))
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        for name in names:   # JIT and Python workers warm, as in a long-lived session
            catalog.REGISTRY[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        drop_scratch(spark)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
