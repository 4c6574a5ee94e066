"""Summarise the executed physical plans of registered queries (after AQE).

usage: python tools/plans.py [sf_dir] [name ...]
Prints, per query: shuffles, broadcasts, join and aggregate strategies,
Python stages and the parquet scans with their read schema.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textlab.plans import catalog  # noqa: E402
from textlab.session import build_session  # noqa: E402

NODES = ("Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
         "Exchange RoundRobinPartitioning", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin",
         "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate",
         "ObjectHashAggregate", "SortAggregate", "Window", "MapInPandas", "FlatMapCoGroupsInPandas",
         "ArrowEvalPython", "Generate", "TakeOrderedAndProject")


def summarize(plan: str) -> tuple[Counter, list[str]]:
    c = Counter()
    for line in plan.splitlines():
        for node in NODES:
            if node in line:
                c[node] += 1
    scans = sorted({m.group(1) + " " + m.group(2) for m in re.finditer(
        r"\[file:[^\]]*/([a-z_]+)\.parquet\].*?ReadSchema: (struct<[^>]*>)", plan)})
    return c, scans


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in args if not a.startswith("/")] or list(catalog.REGISTRY)
    spark = build_session(shuffle_partitions=16)
    for name in names:
        df = catalog.REGISTRY[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        c, scans = summarize(plan)
        print(f"## {name}")
        print("  " + ", ".join(f"{k}: {v}" for k, v in sorted(c.items())))
        for s in scans:
            print("  scan " + s)
    spark.stop()


if __name__ == "__main__":
    main()
