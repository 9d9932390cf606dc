import datetime as dt

import pytest
from pyspark.sql import functions as F

from paritas.operators import reports as R
from paritas.operators import state as ST

T0 = dt.datetime(2024, 1, 1)


def kv(spark, rows):
    return spark.createDataFrame(rows, ST.KV_SCHEMA)


def test_upsert_replaces_and_inserts(spark):
    cur = kv(spark, [("p1", '{"status":"registered"}', T0), ("p2", '{"status":"registered"}', T0)])
    upd = kv(spark, [("p1", '{"status":"landed"}', T0 + dt.timedelta(1)), ("p3", '{"status":"x"}', T0)])
    out = {r["key"]: r["payload"] for r in ST.upsert(cur, upd).collect()}
    assert out == {"p1": '{"status":"landed"}', "p2": '{"status":"registered"}', "p3": '{"status":"x"}'}


def test_latest_update_wins_within_batch(spark):
    upd = kv(spark, [("p1", "a", T0 + dt.timedelta(2)), ("p1", "b", T0 + dt.timedelta(1))])
    assert ST.upsert(None, upd).first()["payload"] == "a"


def test_get_and_scan(spark):
    t = kv(spark, [("p2", '{"status":"b"}', T0 + dt.timedelta(1)), ("p1", '{"status":"a"}', T0)])
    assert ST.get(t, "p1", "status string").first()["status"] == "a"
    assert ST.get(t, "missing", "status string").count() == 0
    assert [r["status"] for r in ST.scan(t, "status string").collect()] == ["a", "b"]
    assert ST.scan(None) is None
    with pytest.raises(ValueError):
        ST.scan(spark.createDataFrame([(1,)], "x INT"))


def progs(spark, ids):
    return spark.createDataFrame([(i, f"/sas/{i}.sas", "owner") for i in ids],
                                 "program_id STRING, sas_path STRING, owner STRING")


def test_register_is_idempotent(spark):
    inv, out = ST.register(None, progs(spark, ["p1"]))
    assert out.first()["registered"] and inv.first()["status"] == "registered"
    inv2, out2 = ST.register(inv, progs(spark, ["p1", "p2"]))
    assert {r["program_id"]: r["registered"] for r in out2.collect()} == {"p1": False, "p2": True}
    assert inv2.count() == 2


def test_set_status_and_pending_and_funnel(spark):
    inv, _ = ST.register(None, progs(spark, ["p1", "p2", "p3"]))
    upd = spark.createDataFrame([("p1", "parity_pass"), ("p2", "triage")], "program_id STRING, status STRING")
    inv = ST.set_status(inv, upd)
    got = {r["program_id"]: r["status"] for r in inv.collect()}
    assert got == {"p1": "parity_pass", "p2": "triage", "p3": "registered"}
    assert sorted(r["program_id"] for r in ST.pending(inv).collect()) == ["p2", "p3"]
    assert [(r["status"], r["n"]) for r in ST.funnel(inv).collect()] == [
        ("parity_pass", 1), ("registered", 1), ("triage", 1)]


def test_set_status_rejects_bad_updates(spark):
    inv, _ = ST.register(None, progs(spark, ["p1"]))
    with pytest.raises(ValueError):
        ST.set_status(inv, spark.createDataFrame([("p1", "done")], "program_id STRING, status STRING"))
    with pytest.raises(KeyError):
        ST.set_status(inv, spark.createDataFrame([("px", "landed")], "program_id STRING, status STRING"))


def test_pending_counts_missing_status(spark):
    df = spark.createDataFrame([("a", None), ("b", "parity_pass")], "program_id STRING, status STRING")
    assert [r["program_id"] for r in ST.pending(df).collect()] == ["a"]


CALLS = "program_id STRING, ts INT, input_tokens LONG, output_tokens LONG, latency_s DOUBLE, error STRING, event_id INT"


def test_budget_trip_is_strict_and_counts_the_tripping_call(spark):
    calls = spark.createDataFrame([("p", 1, 60, 0, 0.1, None, 1), ("p", 2, 40, 0, 0.1, None, 2),
                                   ("p", 3, 1, 0, 0.1, None, 3), ("q", 1, 10, 0, 0.1, None, 4)], CALLS)
    got = {r["program_id"]: (r["trip_call_no"], r["used_at_trip"], r["trip_event_id"])
           for r in R.budget_trips(calls, 100, ["ts"], ident="event_id").collect()}
    assert got == {"p": (3, 101, 3)}


def test_batch_budget_processes_the_tripping_program(spark):
    per = spark.createDataFrame([(1, 50), (2, 60), (3, 10), (4, 5)], "o INT, tokens LONG")
    got = {r["o"]: r["batch_status"] for r in R.batch_budget(per, 100, ["o"]).collect()}
    assert got == {1: "processed", 2: "processed", 3: "pending", 4: "pending"}


def test_failure_runs_ignore_refusals(spark):
    errs = [None, "e", "e", "circuit_open", "e", None, "e", "e"]
    calls = spark.createDataFrame([("p", i, 1, 1, 0.1, e, i) for i, e in enumerate(errs)], CALLS)
    got = [(r["failures"], r["first_event_id"], r["last_event_id"])
           for r in R.failure_runs(calls, 3, ["ts"]).collect()]
    assert got == [(3, 1, 4)]
    assert R.failure_runs(calls, 2, ["ts"]).count() == 2


ATT = "program_id STRING, ts INT, loop STRING, step_index INT, outer_attempt INT, ok BOOLEAN"


def test_outcomes_rules(spark):
    att = spark.createDataFrame([
        ("pass", 1, "run", 0, 1, False), ("pass", 2, "run", 0, 1, True), ("pass", 3, "match", -1, 1, True),
        ("never", 1, "run", 0, 1, False),
        ("div", 1, "run", 0, 1, True), ("div", 2, "match", -1, 1, False),
        ("div", 3, "run", 0, 2, True), ("div", 4, "match", -1, 2, False),
        ("budget", 1, "run", 0, 1, True), ("budget", 2, "match", -1, 1, True)], ATT)
    trips = spark.createDataFrame([("budget",)], "program_id STRING")
    got = {r["program_id"]: (r["status"], r["failure_mode"], r["outer_attempts"], r["run_repairs"])
           for r in R.outcomes(att, ["ts"], trips=trips).collect()}
    assert got == {"pass": ("parity_pass", None, 1, 1), "never": ("triage", "never_ran", 1, 0),
                   "div": ("triage", "diverged", 2, 0), "budget": ("triage", "budget", 1, 0)}


def test_implicated_steps(spark):
    steps = spark.createDataFrame([("p", 0, ["sb.A"]), ("p", 1, ["sb.b"]), ("q", 0, ["x"]), ("q", 3, ["y"])],
                                  "program_id STRING, step_index INT, outputs ARRAY<STRING>")
    failed = spark.createDataFrame([("p", "SB.a"), ("q", "zzz")], "program_id STRING, table STRING")
    got = sorted((r["program_id"], r["step_index"]) for r in R.implicated_steps(steps, failed).collect())
    assert got == [("p", 0), ("q", 3)]


def test_usage_and_metrics(spark):
    calls = spark.createDataFrame([("p", 1, 10, 5, 0.2, None, 1), ("p", 2, 0, 0, 0.0, "circuit_open", 2)], CALLS)
    u = R.usage_summary(calls).first()
    assert (u["calls"], u["errors"], u["refusals"], u["input_tokens"], u["output_tokens"]) == (2, 1, 1, 10, 5)
    status = spark.createDataFrame([("p", "parity_pass"), ("q", "triage")], "program_id STRING, status STRING")
    m = R.migration_metrics(status, calls).first()
    assert (m["programs"], m["pass_rate"], m["triage_rate"], m["calls_per_program"]) == (2, 0.5, 0.5, 1.0)


def test_diff_text_lines_and_truncation(spark):
    tables = spark.createDataFrame([("p1", "t", 10, 10, 0, 0, False, None)],
                                   "program_id STRING, table STRING, gt_rows LONG, out_rows LONG, "
                                   "missing_rows LONG, extra_rows LONG, passed BOOLEAN, error STRING")
    cols = spark.createDataFrame([("p1", "t", "balance", 4, 10), ("p1", "t", "id", 0, 10)],
                                 "program_id STRING, table STRING, column_name STRING, mismatches LONG, total LONG")
    samples = spark.createDataFrame([("p1", "t", "balance", 1, "id=3: balance 1.0 != 2.0")],
                                    "program_id STRING, table STRING, column_name STRING, sample_no INT, sample STRING")
    text = R.diff_text(tables, cols, samples).first()["text"]
    assert text.splitlines() == [
        "[FAIL] table t: ground_truth=10 rows, output=10 rows, missing=0, extra=0",
        "  column balance: 4/10 mismatched (40.00%)",
        "    sample: id=3: balance 1.0 != 2.0"]
    short = R.diff_text(tables, cols, samples, max_chars=20).first()["text"]
    assert short.endswith("...(truncated)") and len(short) <= 40


def test_certificate_and_triage_text(spark):
    progs_df = spark.createDataFrame([("p1", "/sas/p1.sas", "ann", None), ("p2", "/sas/p2.sas", "bo", 1e-6)],
                                     "program_id STRING, sas_path STRING, owner STRING, float_rel_tol DOUBLE")
    outcome = spark.createDataFrame([("p1", 2, 1, None), ("p2", 1, 3, "never_ran")],
                                    "program_id STRING, outer_attempts LONG, run_repairs LONG, failure_mode STRING")
    tables = spark.createDataFrame([("p1", "sb.out", 1000, 1000, True, "keyed rel_tol=1e-09")],
                                   "program_id STRING, table STRING, gt_rows LONG, out_rows LONG, passed BOOLEAN, method STRING")
    snaps = spark.createDataFrame([("p1", "staging.c", "ab12ef34cd56")], "program_id STRING, table STRING, hash STRING")
    certs = {r["program_id"]: r["certificate"] for r in R.certificates(
        progs_df, outcome, tables, snaps, 1e-9, F.lit("2026-01-01T00:00:00")).collect()}
    c = certs["p1"]
    assert "| sb.out | 1000 | 1000 | PASS | keyed rel_tol=1e-09 |" in c
    assert "1.0e-09" in c and "ab12ef34cd56" in c and "10 significant digits" in c
    assert "outer attempts: 2" in c
    assert "1.0e-06" in certs["p2"] and "(none recorded)" in certs["p2"]
    ev = spark.createDataFrame([("p2", "Traceback: AnalysisException")], "program_id STRING, text STRING")
    steps = spark.createDataFrame([("p2", 1, "sql", "SELECT broken"), ("p2", 2, "pyspark", "df.show()")],
                                  "program_id STRING, step_index INT, language STRING, code STRING")
    rep = {r["program_id"]: r["report"] for r in R.triage_reports(progs_df, outcome, ev, steps).collect()}
    assert "never_ran" in rep["p2"] and "AnalysisException" in rep["p2"] and "SELECT broken" in rep["p2"]
    assert "```python\ndf.show()" in rep["p2"] and "(no error text)" in rep["p1"] and "- filed at: 2" in rep["p1"]


def test_evidence_by_failure_mode(spark):
    outcome = spark.createDataFrame([("a", "diverged"), ("b", "never_ran"), ("c", "diverged"), ("d", "budget"), ("e", None)],
                                    "program_id STRING, failure_mode STRING")
    errors = spark.createDataFrame([(p, f"error of {p}") for p in "abc"], "program_id STRING, text STRING")
    diffs = spark.createDataFrame([(p, f"diff of {p}") for p in "abe"], "program_id STRING, text STRING")
    got = {r["program_id"]: r["text"] for r in R.triage_evidence(outcome, errors, diffs).collect()}
    assert got == {"a": "diff of a", "b": "error of b", "c": "error of c", "d": None, "e": None}
    rep = R.triage_reports(outcome.withColumn("sas_path", F.lit("x")).withColumn("owner", F.lit("o")).drop("failure_mode"),
                           outcome.withColumn("outer_attempts", F.lit(1)).withColumn("run_repairs", F.lit(0)),
                           R.triage_evidence(outcome, errors, diffs), None, F.lit("2026-01-01T00:00:00"))
    text = {r["program_id"]: r["report"] for r in rep.collect()}
    assert "diff of a" in text["a"] and "- filed at: 2026-01-01T00:00:00" in text["a"] and "(no error text)" in text["d"]


def test_program_table_pairs_and_validate_inventory(spark):
    from paritas.operators import compare as C
    spark.sql("CREATE SCHEMA IF NOT EXISTS gt_s")
    spark.sql("CREATE SCHEMA IF NOT EXISTS sandbox_p9")
    spark.createDataFrame([(1, 1.0), (2, 2.0)], "id INT, v DOUBLE").write.mode("overwrite").saveAsTable("gt_s.p9_out")
    spark.createDataFrame([(1, 1.0), (2, 2.5)], "id INT, v DOUBLE").write.mode("overwrite").saveAsTable("sandbox_p9.out")
    inv = spark.createDataFrame([("p9", {"work.out": "gt_s.p9_out", "work.gone": "gt_s.p9_out"},
                                  {"work.out": ["id"]}, None)],
                                "program_id STRING, ground_truth MAP<STRING,STRING>, "
                                "keys MAP<STRING,ARRAY<STRING>>, float_rel_tol DOUBLE")
    pairs = {r["output_name"]: (r["out_table"], r["keys"]) for r in C.program_table_pairs(inv).collect()}
    assert pairs == {"work.out": ("sandbox_p9.out", ["id"]), "work.gone": ("sandbox_p9.gone", None)}
    res = C.validate_inventory(spark, inv)
    by_table = {t["table"]: t for t in res.tables}
    assert by_table["sandbox_p9.gone"]["method"] == "error" and {t["program_id"] for t in res.tables} == {"p9"}
    assert [(c["table"], c["mismatches"]) for c in res.columns] == [("sandbox_p9.out", 1)] and not res.passed


def test_latest_by_time_replays_a_stream(spark):
    rows = kv(spark, [("p1", "a", T0), ("p1", "b", T0 + dt.timedelta(2)), ("p2", "c", T0),
                      ("p1", "x", T0 + dt.timedelta(1))])
    assert {r["key"]: r["payload"] for r in ST.latest_by_time(rows).collect()} == {"p1": "b", "p2": "c"}


def test_to_kv_puts_other_columns_in_payload(spark):
    rows = spark.createDataFrame([("p1", "landed", 3, T0)], "pid STRING, status STRING, n INT, at TIMESTAMP")
    kvdf = ST.to_kv(rows, "pid", ts="at")
    r = kvdf.first()
    assert kvdf.columns == list(ST.KV_COLS) and r["key"] == "p1" and r["updated_at"] == T0
    assert r["payload"] == '{"pid":"p1","status":"landed","n":3}'


def test_diff_text_is_whole(spark):
    t = spark.createDataFrame([("p", "t", 9, 9, 0, 0, None, False)], "program_id string, table string, gt_rows long, out_rows long, "
                              "missing_rows long, extra_rows long, error string, passed boolean")
    cols = spark.createDataFrame([("p", "t", f"c{i:03d}", 8, 9) for i in range(200)], "program_id string, table string, column_name string, mismatches long, total long")
    samples = spark.createDataFrame([("p", "t", f"c{i:03d}", k, f"id={k}: x != y") for i in range(200) for k in range(1, 9)],
                                    "program_id string, table string, column_name string, sample_no int, sample string")
    text = R.diff_text(t, cols, samples).first()["text"]
    assert len(text) > 30_000 and text.count("sample: ") == 1600
    cut = R.diff_text(t, cols, samples, max_chars=100).first()["text"]
    assert cut.endswith("...(truncated)") and len(cut) < 130


def test_tolerance_is_printed_in_full(spark):
    got = [r[0] for r in spark.createDataFrame([(1e-9,), (1.25e-9,), (0.05,)], "t double").select(R.tol_text(F.col("t"))).collect()]
    assert got == ["1.0e-09", "1.25E-9", "5.0e-02"]
