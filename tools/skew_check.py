"""Skew rehearsal: one key, group or repeated row holds a third of the rows.

    python tools/skew_check.py [sf_dir] > SKEW.md

Over lineitem with one value made hot, runs: a running sum per group with
the chunked ordered scan and as a plain ``Window.partitionBy(group)``;
NODUPKEY on the hot key; keyed parity with the hot key repeated on both
sides; keyless parity where a third of the rows are identical; and a 1:n
merge whose many side has the hot key (broadcast off and the skew-join
thresholds lowered so adaptive execution treats this small data as skewed).
From Spark's event log (written to a fresh scratch folder) it reports the
largest and median number of rows any task read from a shuffle in each run.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.window import Window  # noqa: E402

from paritas.operators.scan import ordered_scan  # noqa: E402
from paritas.session import build_session  # noqa: E402


def task_reads(log_dir: str, group: str) -> list[int]:
    """Shuffle records read per task, for the jobs of one job group."""
    jobs, stages, reads = set(), {}, {}
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)):
        if os.path.isdir(path):
            continue
        with open(path) as f:
            for line in f:
                e = json.loads(line)
                ev = e.get("Event")
                if ev == "SparkListenerJobStart":
                    props = e.get("Properties") or {}
                    if props.get("spark.jobGroup.id") == group:
                        jobs.add(e["Job ID"])
                        for sid in e.get("Stage IDs", []):
                            stages[sid] = e["Job ID"]
                elif ev == "SparkListenerTaskEnd" and e.get("Stage ID") in stages:
                    m = (e.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
                    n = m.get("Total Records Read", 0)
                    if n:
                        reads.setdefault(e["Stage ID"], []).append(n)
    return [n for ns in reads.values() for n in ns]


CHUNKS = int(os.environ["SKEW_CHUNKS"]) if "SKEW_CHUNKS" in os.environ else None


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="paritas-eventlog-")
    spark = build_session("local[8]", app="paritas-skew", shuffle_partitions=32,
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.eventLog.compress": "false",
                                 "spark.sql.adaptive.coalescePartitions.enabled": "false",
                                 "spark.sql.autoBroadcastJoinThreshold": "-1",
                                 "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                                 "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
                                 "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k"})
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    k = F.col("l_orderkey")
    df = li.select(F.when(k % 3 == 0, F.lit(0)).otherwise(k % 1000 + 1).alias("g"),
                   "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    n = df.count()
    hot = df.filter("g = 0").count()
    sc = spark.sparkContext

    sc.setJobGroup("chunked", "chunked scan")
    ordered_scan(df, ["g"], order, sums={"s": F.col("l_quantity")}, num_chunks=CHUNKS).write.format("noop").mode("overwrite").save()
    sc.setJobGroup("plain", "plain window")
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df.withColumn("s", F.sum("l_quantity").over(w)).write.format("noop").mode("overwrite").save()

    from paritas.operators import compare as C
    from paritas.operators import sas as SO
    sc.setJobGroup("nodupkey", "nodupkey on the hot key")
    SO.nodupkey(df, ["g"], order).write.format("noop").mode("overwrite").save()
    sc.setJobGroup("keyed", "keyed parity, hot key repeated on both sides")
    keyed = C.compare_frames(df, df.select(*reversed(df.columns)), keys=["g"])
    same = li.select("l_returnflag", "l_linestatus", F.when(k % 3 == 0, F.lit(0)).otherwise(k).alias("k"))
    sc.setJobGroup("keyless", "keyless parity, a third of the rows identical")
    keyless = C.compare_frames(same, same)
    ones = df.select("g").distinct().withColumn("label", F.concat(F.lit("g"), F.col("g").cast("string")))
    # The many side as a multi-file input would arrive: spread over 32 map
    # tasks (adaptive execution splits a skewed partition along map outputs).
    many = li.select(F.when(k % 3 == 0, F.lit(0)).otherwise(k % 1000 + 1).alias("g"), "l_quantity",
                     "l_extendedprice", "l_partkey", "l_suppkey", "l_orderkey", "l_shipdate").repartition(32)
    sc.setJobGroup("merge", "1:n merge, hot key on the many side")
    merged = SO.merge_by(ones, many, ["g"], group_rows=10_000)  # the hot group is large here
    merged.collect()
    final = merged._jdf.queryExecution().executedPlan().toString()
    skew_split = "SortMergeJoin(skew=true)" in final
    spark.stop()
    assert keyed.passed and "fallback" in keyed.method and keyless.passed

    print("# Skew rehearsal\n")
    print(f"lineitem at `{sf}`: {n} rows, group 0 holds {hot} ({hot / n:.0%}); "
          "32 shuffle partitions, partition coalescing off so tasks stay visible.\n")
    print("Chunked scan with the default chunk count (4 per shuffle partition).\n")
    print("| plan | tasks reading a shuffle | max rows read by one task | median | max / (rows / 32) |")
    print("|---|---|---|---|---|")
    labels = {"chunked": "running sum, chunked scan", "plain": "running sum, plain window",
              "nodupkey": "NODUPKEY (partial min_by)", "keyed": "keyed parity, repeated hot key",
              "keyless": "keyless parity, 1/3 identical rows", "merge": "1:n merge, hot key (AQE skew join)"}
    for name, label in labels.items():
        r = task_reads(log_dir, name)
        print(f"| {label} | {len(r)} | {max(r)} | {int(statistics.median(r))} | {max(r) / (n / 32):.2f} |")
    print("\nKeyed parity: the repeated hot key collapses map-side in the per-key reduction; the "
          "largest read comes from the keyless fallback it then runs, which hashes 600k distinct rows "
          "per side into 32 even partitions.")
    print(f"\nThe merge's final adaptive plan {'splits' if skew_split else 'does NOT split'} the hot "
          "partition (`SortMergeJoin(skew=true)` over `AQEShuffleRead skewed`). Its largest read above "
          "comes from the stage spreading the input over 32 map tasks, which is round-robin.")


if __name__ == "__main__":
    main()
