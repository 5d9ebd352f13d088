"""Summarise the static physical plan of every registered query.

Usage: python tools/plan_report.py [sf_dir] > plan_table.md
Counts shuffles (hash / range / single-partition), broadcasts, join kinds,
partial aggregates, WindowGroupLimit and Python evaluation per query.
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")


def main():
    from tradelens.plans.catalog import QUERIES
    from tradelens.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    print("| query | hash shuffles | range shuffles | single-partition | broadcasts | SMJ | BHJ | partial aggs | WindowGroupLimit | Python |")
    print("|---|---|---|---|---|---|---|---|---|---|")
    for name, fn in sorted(QUERIES.items()):
        p = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        row = [
            len(re.findall(r"Exchange hashpartitioning", p)),
            len(re.findall(r"Exchange rangepartitioning", p)),
            len(re.findall(r"Exchange SinglePartition", p)),
            p.count("BroadcastExchange"),
            p.count("SortMergeJoin"),
            p.count("BroadcastHashJoin"),
            len(re.findall(r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_", p)),
            p.count("WindowGroupLimit"),
            "yes" if ("ArrowEvalPython" in p or "BatchEvalPython" in p) else "",
        ]
        print(f"| {name} | " + " | ".join(str(x) for x in row) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
