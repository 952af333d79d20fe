"""Report scale red flags in the physical plans of registered queries.

Usage: python scripts/plan_lint.py [sf_dir] [query ...]

Flags: cartesian / nested-loop joins, exchanges to a single partition, windows
without a partition key, sort-based aggregates; and prints each scan's
ReadSchema so column pruning can be checked by eye.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from promptframe.plans import QUERIES  # noqa: E402
from promptframe.session import get_session  # noqa: E402

FLAGS = {
    "CartesianProduct": "cartesian product",
    "BroadcastNestedLoopJoin": "nested-loop join",
    "SinglePartition": "exchange to one partition",
    "SortAggregate": "sort-based aggregate",
}


def lint(plan: str) -> list[str]:
    out = [msg for key, msg in FLAGS.items() if key in plan]
    for m in re.finditer(r"Window \[.*?\], \[\]", plan):
        out.append("window without partition key")
        break
    return out


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if a != sf_dir] or sorted(QUERIES)
    spark = get_session("local[8]", 8)
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        qe = df._jdf.queryExecution()
        plan = qe.executedPlan().toString()
        flags = lint(plan)
        schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*>)", qe.explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))))
        print(f"{name:22s} exchanges={plan.count('Exchange ')} flags={flags}")
        for s in schemas:
            print(f"{'':22s} {s[:150]}")


if __name__ == "__main__":
    main()
