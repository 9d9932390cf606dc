"""Summarize the physical plan of every registered query into PLANS.md.

    python tools/plan_report.py [sf_dir] > PLANS.md

Per query: shuffles (by partitioning), joins, aggregates, windows, and for
every parquet scan the columns read and the filters pushed into it. Plans
are taken before execution (AQE may still switch a sort-merge join to a
broadcast at runtime once it has measured the sizes).
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paritas.plans.queries import REGISTRY  # noqa: E402
from paritas.session import build_session  # noqa: E402

NODES = ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
         "CartesianProduct", "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Window",
         "WindowGroupLimit", "Generate", "Expand", "Union")


def summarize(df, spark) -> list[str]:
    qe = df._jdf.queryExecution()
    text = qe.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    head = text.split("\n\n(1)")[0]
    nodes = Counter()
    for n in NODES:
        nodes[n] = len(re.findall(rf"\b{n}\b(?! \[)", head))
    parts = [f"{k} x{v}" for k, v in nodes.items() if v]
    exch = Counter(re.findall(r"Arguments: (hashpartitioning|rangepartitioning|SinglePartition|"
                              r"RoundRobinPartitioning)", text))
    lines = ["- operators: " + (", ".join(parts) or "scan/project only"),
             "- shuffles: " + (", ".join(f"{k} x{v}" for k, v in exch.items()) or "none")]
    scans = re.findall(r"\(\d+\) Scan parquet[^\n]*\n(?:[^\n]+\n)*?Location: [^\[]*\[([^\]]*)\]"
                       r"(?:\n(?:PushedFilters: \[([^\]]*)\]))?(?:\n[^\n]*)*?\nReadSchema: struct<([^>]*)>",
                       text)
    seen = set()
    for loc, pushed, schema in scans:
        table = os.path.basename(loc.split(",")[0].strip()).replace(".parquet", "")
        key = (table, pushed, schema)
        if key in seen:
            continue
        seen.add(key)
        cols = [c.split(":")[0] for c in schema.split(",")] if schema else []
        lines.append(f"- scan `{table}`: {len(cols)} column(s) {', '.join(cols)}"
                     + (f"; pushed: {pushed}" if pushed else ""))
    return lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` on `{sf}` before execution; AQE may still "
          "re-plan joins and coalesce partitions at runtime.\n")
    for name, q in REGISTRY.items():
        df = q(spark, sf)
        print(f"## {name}\n")
        print("\n".join(summarize(df, spark)))
        print()
    spark.stop()


if __name__ == "__main__":
    main()
