import pandas as pd
import pytest
from pyspark.sql import functions as F

from paritas.operators import sas as SO
from paritas.operators.scan import ordered_scan
from tests.conftest import SF_SMALL


def skewed(spark, n=3000):
    # Group 0 holds a third of all rows; values missing on every 4th row.
    rows = []
    for i in range(n):
        g = 0 if i % 3 == 0 else (i % 37) + 1
        v = None if i % 4 == 0 else float(i % 11)
        rows.append((g, i, v))
    return spark.createDataFrame(rows, "g INT, t INT, v DOUBLE")


def brute(pdf):
    pdf = pdf.sort_values(["g", "t"]).copy()
    grp = pdf.groupby("g", sort=False)
    pdf["run"] = grp["v"].transform(lambda s: s.fillna(0).cumsum())
    pdf["locf"] = grp["v"].transform(lambda s: s.ffill())
    pdf["pos"] = grp.cumcount() + 1
    pdf["first"] = pdf["pos"] == 1
    pdf["last"] = pdf["pos"] == grp["t"].transform("count")
    return pdf.set_index("t")


@pytest.mark.parametrize("chunks", [1, 5, 16])
def test_ordered_scan_matches_brute_force_on_hot_group(spark, chunks):
    df = skewed(spark)
    out = ordered_scan(df, ["g"], ["t"], sums={"run": F.col("v")}, locf={"locf": F.col("v")},
                       position="pos", first="first", last="last", num_chunks=chunks).toPandas()
    exp = brute(df.toPandas())
    out = out.set_index("t").loc[exp.index]
    assert (out["pos"].values == exp["pos"].values).all()
    assert (out["first"].values == exp["first"].values).all()
    assert (out["last"].values == exp["last"].values).all()
    assert ((out["run"] - exp["run"]).abs() < 1e-9).all()
    both = out["locf"].isna() == exp["locf"].isna()
    assert both.all() and ((out["locf"] - exp["locf"]).abs().fillna(0) < 1e-12).all()


def test_chunks_are_even_contiguous_and_need_no_checkpoint(spark):
    from paritas.operators.scan import CHUNK, chunk
    df = skewed(spark)
    x = chunk(df, ["g", "t"], 16)
    rows = sorted((r["g"], r["t"], r[CHUNK]) for r in x.collect())
    chunks = [c for _, _, c in rows]
    assert chunks == sorted(chunks) and set(chunks) == set(range(16))
    sizes = [chunks.count(c) for c in range(16)]
    assert max(sizes) < 2 * 3000 / 16 and len({c for g, _, c in rows if g == 0}) > 3
    again = {(r["g"], r["t"]): r[CHUNK] for r in chunk(df.repartition(7), ["g", "t"], 16).collect()}
    assert again == {(g, t): c for g, t, c in rows}
    plan = ordered_scan(df, ["g"], ["t"], position="p", num_chunks=16)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD[g" in plan and "checkpoint" not in plan.lower()
    assert [r[CHUNK] for r in chunk(df.limit(0), ["g"], 4).collect()] == []


def test_scan_without_by_and_totals(spark):
    df = spark.createDataFrame([(i, 1) for i in range(50)], "t INT, one INT")
    out = ordered_scan(df, [], ["t"], sums={"c": F.col("one")}, totals=["c"], num_chunks=4)
    rows = sorted(out.collect(), key=lambda r: r["t"])
    assert [r["c"] for r in rows] == list(range(1, 51)) and {r["c_total"] for r in rows} == {50}


def test_scan_null_by_values_form_a_group(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), (1, 1, 5.0)], "g INT, t INT, v DOUBLE")
    out = {(r["g"], r["t"]): r["s"] for r in ordered_scan(df, ["g"], ["t"], sums={"s": F.col("v")}).collect()}
    assert out == {(None, 1): 1.0, (None, 2): 3.0, (1, 1): 5.0}


def test_first_last_two_levels(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b", 1, 4)], "x STRING, y INT, t INT")
    out = {r["t"]: (r["first_x"], r["last_x"], r["first_y"], r["last_y"])
           for r in SO.first_last(df, ["x", "y"], ["t"]).collect()}
    assert out == {1: (True, False, True, False), 2: (False, False, False, True),
                   3: (False, True, True, True), 4: (True, True, True, True)}


def test_retain_and_running_total(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (1, 3, 2.0), (2, 1, None)], "g INT, t INT, v DOUBLE")
    r = SO.running_total(SO.retain(df, ["g"], ["t"], {"kept": "v"}), ["g"], ["t"], {"tot": F.col("v")})
    got = {(x["g"], x["t"]): (x["kept"], x["tot"]) for x in r.collect()}
    assert got == {(1, 1): (5.0, 5.0), (1, 2): (5.0, 5.0), (1, 3): (2.0, 7.0), (2, 1): (None, 0.0)}


def test_nodupkey_keeps_first_in_order(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (2, 5, "z"), (2, 5, "y")],
                               "id INT, ord INT, val STRING")
    got = {r["id"]: (r["ord"], r["val"]) for r in SO.nodupkey(df, ["id"], ["ord"]).collect()}
    assert got == {1: (1, "a"), 2: (5, "y")}       # ties broken by the remaining columns


def test_proc_means_output_type_and_freq(spark):
    df = spark.createDataFrame([("east", "x", 1.0), ("east", "y", 3.0), ("west", "x", None)],
                               "region STRING, seg STRING, bal DOUBLE")
    out = SO.proc_means_output(df, ["region", "seg"], {"avg_bal": ("mean", "bal"), "n_bal": ("n", "bal")})
    got = {(r["region"], r["seg"], r["_TYPE_"]): (r["_FREQ_"], r["avg_bal"], r["n_bal"]) for r in out.collect()}
    assert got[(None, None, 0)] == (3, 2.0, 2)
    assert got[("east", None, 2)] == (2, 2.0, 2)
    assert got[(None, "x", 1)] == (2, 1.0, 1)
    assert got[("west", "x", 3)] == (1, None, 0)
    nway = SO.proc_means_output(df, ["region", "seg"], {"avg_bal": ("mean", "bal")}, nway=True)
    assert {r["_TYPE_"] for r in nway.collect()} == {3}


def test_proc_means_defaults_single_row_std_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0), ("b", float("nan"))], "k STRING, v DOUBLE")
    got = {r["k"]: r for r in SO.proc_means(df, ["v"], ["k"]).collect()}
    assert got["a"]["v_std"] is None and got["a"]["v_n"] == 1
    assert got["b"]["v_n"] == 2 and got["b"]["v_mean"] == 3.0


def test_proc_freq_oneway(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "x STRING")
    rows = sorted(SO.proc_freq(df, "x", num_chunks=2).collect(), key=lambda r: r["x"])
    assert [(r["x"], r["frequency"], r["cum_frequency"]) for r in rows] == [("a", 1, 1), ("b", 2, 3)]
    assert abs(rows[0]["percent"] - 100 / 3) < 1e-9 and rows[1]["cum_percent"] == 100.0


def test_proc_freq_twoway(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("a", "x")], "r STRING, c STRING")
    got = {(r["r"], r["c"]): r for r in SO.proc_freq_2way(df, "r", "c").collect()}
    ax = got[("a", "x")]
    assert ax["frequency"] == 2 and ax["percent"] == 50.0
    assert abs(ax["row_percent"] - 200 / 3) < 1e-9 and abs(ax["col_percent"] - 200 / 3) < 1e-9


def test_transpose_round_trip(spark):
    long = spark.createDataFrame([(1, "q1", 10.0), (1, "q2", 20.0), (2, "q1", 5.0)], "id INT, k STRING, v DOUBLE")
    wide = SO.transpose_wide(long, ["id"], "k", "v")
    got = {r["id"]: (r["_NAME_"], r["q1"], r["q2"]) for r in wide.collect()}
    assert got == {1: ("v", 10.0, 20.0), 2: ("v", 5.0, None)}
    back = SO.transpose_long(wide.drop("_NAME_"), ["id"], ["q1", "q2"])
    assert back.filter("COL1 IS NOT NULL").count() == 3


def test_transpose_numeric_ids_get_prefix(spark):
    long = spark.createDataFrame([(1, 1, 3.0), (1, 2, 4.0)], "id INT, n INT, v DOUBLE")
    assert SO.transpose_wide(long, ["id"], "n", "v").columns == ["id", "_NAME_", "_1", "_2"]


@pytest.mark.parametrize("swap", [False, True])
def test_merge_of_large_groups_gives_the_same(spark, swap):
    """The split path and the full join agree, null keys and unmatched rows included."""
    one = spark.createDataFrame([(k, f"o{k}") for k in (1, 2, 3, None, 9)], "k INT, s STRING")
    many = spark.createDataFrame([(k, f"m{i}", i) for i, k in enumerate([1, 1, 1, 3, None, None, 7, 7])], "k INT, s STRING, b INT")
    a, b = (many, one) if swap else (one, many)
    rows = [sorted(map(tuple, SO.merge_by(a, b, ["k"], group_rows=n).collect()), key=str) for n in (1, 1000)]
    assert rows[0] == rows[1] and len(rows[0]) == 10


def test_merge_one_to_many_right_wins(spark):
    left = spark.createDataFrame([(1, "L1", 10), (2, "L2", 20), (4, "L4", 40)], "k INT, s STRING, a INT")
    right = spark.createDataFrame([(1, "R1", 100), (1, "R1b", 101), (3, "R3", 300)], "k INT, s STRING, b INT")
    got = sorted((r["k"], r["s"], r["a"], r["b"], r["in_left"], r["in_right"])
                 for r in SO.merge_by(left, right, ["k"]).collect())
    assert got == [(1, "R1", 10, 100, True, True), (1, "R1b", 10, 101, True, True),
                   (2, "L2", 20, None, True, False), (3, "R3", None, 300, False, True),
                   (4, "L4", 40, None, True, False)]


def test_merge_many_to_many_raises(spark):
    d = spark.createDataFrame([(1, 1), (1, 2)], "k INT, v INT")
    with pytest.raises(ValueError):
        SO.merge_by(d, d.withColumnRenamed("v", "w"), ["k"])


def test_data_step_where_with_missing(spark):
    from paritas.functions import sas as S
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0)], "k INT, v DOUBLE")
    assert [r["k"] for r in SO.data_step_where(df, S.sas_ge("v", F.lit(2.0))).collect()] == [2]
    assert sorted(r["k"] for r in SO.data_step_where(df, S.sas_lt("v", F.lit(2.0))).collect()) == [1, 3]


def test_sas_sort_global(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "k INT, s STRING")
    assert [r["k"] for r in SO.sas_sort(df, ["s"]).collect()] == [2, 3, 1]


def test_first_last_on_events_file(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    out = SO.first_last(ev.select("event_id", "ts", "user_id"), ["user_id"], ["ts", "event_id"])
    n_users = ev.select("user_id").distinct().count()
    assert out.filter("first_user_id").count() == n_users == out.filter("last_user_id").count()


def test_where_sas_semantics_and_pushdown(spark, tmpdir_path):
    import datetime as dt
    path = f"{tmpdir_path}/w.parquet"
    spark.createDataFrame([(1, None), (2, dt.date(1994, 1, 1)), (3, dt.date(1996, 1, 1))],
                          "k INT, d DATE").write.parquet(path)
    df = spark.read.parquet(path)
    d = dt.date(1995, 1, 1)
    ks = lambda op: sorted(r["k"] for r in SO.where_sas(df, "d", op, d).collect())
    assert ks(">=") == [3] and ks("<") == [1, 2] and ks("^=") == [1, 2, 3] and ks("=") == []
    plan = SO.where_sas(df, "d", ">=", d)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(d), GreaterThanOrEqual(d,1995-01-01)]" in plan
    plan = SO.where_sas(df, "d", "<", d)._jdf.queryExecution().executedPlan().toString()
    assert "Or(IsNull(d),LessThan(d,1995-01-01))" in plan


def test_missing_class_values_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, v double")
    out = {(r["_TYPE_"], r["g"]): r["_FREQ_"] for r in SO.proc_means_output(df, ["g"], {"m": ("mean", "v")}).collect()}
    assert out == {(0, None): 2, (1, "a"): 2}
    out = {(r["_TYPE_"], r["g"]): r["_FREQ_"] for r in SO.proc_means_output(df, ["g"], {"m": ("mean", "v")}, missing=True).collect()}
    assert out == {(0, None): 3, (1, "a"): 2, (1, None): 1}


def test_transpose_reports_repeated_missing_and_clashing_ids(spark):
    s = "b int, id string, v double"
    for rows in ([(1, "x", 1.0), (1, "x", 5.0)], [(1, None, 1.0)], [(1, "x", 1.0), (2, "X", 2.0)]):
        with pytest.raises(ValueError):
            SO.transpose_wide(spark.createDataFrame(rows, s), ["b"], "id", "v")
    r = SO.transpose_wide(spark.createDataFrame([(1, "x", 1.0), (1, "x", 5.0), (1, None, 2.0)], s), ["b"], "id", "v", let=True).first()
    assert (r["x"], r["_"]) == (5.0, 2.0)
