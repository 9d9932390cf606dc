"""Bucketed snapshots and re-checks that read only what changed."""

import pytest
from pyspark.sql import functions as F

from paritas.operators import compare as C
from paritas.operators import recheck as RC
from paritas.plans import inputs as I
from tests.conftest import SF_SMALL


def test_equal_to_the_whole_compare_and_reads_only_changed_buckets(spark, tmpdir_path):
    g = I.table(spark, SF_SMALL, "orders")
    o = I.orders_slightly_corrupted(g).select(*reversed(g.columns))
    paths = [RC.bucketed_snapshot(x, "orders", tmpdir_path, ["o_orderkey"], 32) for x in (g, o)]
    whole = C.keyed_summary(C.align(g, o), ["o_orderkey"]).first()
    assert RC.recheck(spark, *paths).first() == whole and not whole["passed"]
    changed, rows = RC.changed_buckets(spark, *paths)
    assert 0 < len(changed) < 32 and 0 < rows < g.count()
    files = [r[0] for r in RC.read_buckets(spark, paths[0], changed).select(F.input_file_name()).distinct().collect()]
    assert files and {int(f.split("_bucket=")[1].split("/")[0]) for f in files} <= set(changed)
    plan = RC.recheck(spark, *paths)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_equal_tables_read_nothing(spark, tmpdir_path):
    g = I.table(spark, SF_SMALL, "customer")
    same = g.repartition(5).select(*reversed(g.columns))
    a, b = (RC.bucketed_snapshot(x, n, tmpdir_path, ["c_custkey"]) for x, n in ((g, "a"), (same, "b")))
    assert a.rpartition("_")[2] == b.rpartition("_")[2] and RC.changed_buckets(spark, a, b) == ([], g.count())
    row = RC.recheck(spark, a, b).first()
    assert row["passed"] and row["gt_rows"] == row["matched_rows"] == g.count()
    assert RC.bucketed_snapshot(same, "a", tmpdir_path, ["c_custkey"]) == a


def test_edges(spark, tmpdir_path):
    schema = "id INT, v DOUBLE, t STRING"
    rows = [(1, 0.0, "a"), (2, float("nan"), None), (2, 1.0, ""), (None, None, "n")]
    g, o = spark.createDataFrame(rows, schema), spark.createDataFrame([(1, -0.0, "a"), (2, None, None), (2, 1.0, ""), (None, None, "n")], schema)
    a, b, none = (RC.bucketed_snapshot(x, "t", tmpdir_path, ["id"], 8) for x in (g, o, g.limit(0)))
    assert RC.recheck(spark, a, b).first() == C.keyed_summary(C.align(g, o), ["id"]).first()
    assert RC.recheck(spark, a, none).first() == C.keyed_summary(C.align(g, g.limit(0)), ["id"]).first()
    assert RC.recheck(spark, none, none).first()["passed"]
    with pytest.raises(ValueError, match="different keys"):
        RC.recheck(spark, a, RC.bucketed_snapshot(g, "u", tmpdir_path, ["id"], 16))
    with pytest.raises(ValueError, match="different keys"):
        RC.recheck(spark, a, RC.bucketed_snapshot(g.withColumn("id", F.col("id").cast("long")), "w", tmpdir_path, ["id"], 8))
    with pytest.raises(ValueError, match="no complete"):
        RC.recheck(spark, a, f"{tmpdir_path}/nothing")
