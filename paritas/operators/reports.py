"""Reports over the call log, the attempt log and parity results.

Call log    program_id, ts, model, purpose, input_tokens, output_tokens,
            latency_s, error (NULL on success; ``circuit_open`` marks a call
            refused by an open breaker, which is neither a failure nor a success)
Attempt log program_id, ts, loop ('run' | 'match'), step_index (-1 for match),
            outer_attempt, ok

Running values per program go through the skew-safe ordered scan; per-program
results are single aggregations with map-side partial steps. Text reports are
assembled per program from a bounded number of lines (tables x columns x
samples), never from the data rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.operators.scan import ordered_scan

REFUSED = "circuit_open"


def _ord(order: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in order])


# ---------------------------------------------------------------- R6

def usage_summary(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, errors, refusals, tokens and mean latency per group."""
    by = by or ["program_id"]
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count("error").alias("errors"),
        F.count_if(F.col("error") == REFUSED).alias("refusals"),
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.avg("latency_s").alias("avg_latency_s"))


def migration_metrics(status: DataFrame, calls: DataFrame) -> DataFrame:
    """One row of sizing metrics: programs, pass rate, triage rate, calls per program.

    Both inputs are reduced to one partial row each, stacked and reduced again
    (no join between the two aggregates)."""
    n = F.lit(None).cast("long")
    s = status.agg(F.count(F.lit(1)).alias("programs"),
                   F.count_if(F.col("status") == "parity_pass").alias("passed"),
                   F.count_if(F.col("status") == "triage").alias("triaged")).withColumn("calls", n)
    c = calls.agg(F.count(F.lit(1)).alias("calls")).select(
        n.alias("programs"), n.alias("passed"), n.alias("triaged"), "calls")
    j = s.unionByName(c).agg(*[F.max(x).alias(x) for x in ("programs", "passed", "triaged", "calls")])
    return j.select(
        F.col("programs").cast("long").alias("programs"),
        (F.col("passed") / F.col("programs")).alias("pass_rate"),
        (F.col("triaged") / F.col("programs")).alias("triage_rate"),
        (F.col("calls") / F.col("programs")).alias("calls_per_program"))


# ---------------------------------------------------------------- W4

def budget_trips(calls: DataFrame, cap: int, order: list[str], by: str = "program_id",
                 ident: str | None = None) -> DataFrame:
    """First call per program whose cumulative tokens exceed ``cap`` (strictly);
    the tripping call itself is counted, as the budget charges before checking."""
    tokens = F.coalesce(F.col("input_tokens"), F.lit(0)) + F.coalesce(F.col("output_tokens"), F.lit(0))
    # Only what the scan needs is chunked and checkpointed.
    keep = list(dict.fromkeys([by, *order, *([ident] if ident else [])]))
    narrow = calls.select(*[F.col(f"`{c}`") for c in keep], tokens.alias("_tokens"))
    s = ordered_scan(narrow, [by], order, sums={"used": F.col("_tokens")}, position="call_no")
    fields = [F.col("call_no"), F.col("used")] + ([F.col(f"`{ident}`")] if ident else [])
    trips = s.filter(F.col("used") > cap).groupBy(by).agg(
        F.min_by(F.struct(*fields), F.col("call_no")).alias("_t"))
    out = [F.col(by), F.col("_t.call_no").alias("trip_call_no"),
           F.col("_t.used").cast("long").alias("used_at_trip")]
    if ident:
        out.append(F.col(f"_t.{ident}").alias(f"trip_{ident}"))
    return trips.select(*out)


def batch_budget(program_tokens: DataFrame, cap: int, order: list[str],
                 tokens: str = "tokens") -> DataFrame:
    """Batch form: programs in ``order`` charge their tokens to one batch cap;
    a program is processed while nothing before it tripped the cap (so the
    tripping program is processed and the rest stay pending)."""
    s = ordered_scan(program_tokens, [], order, sums={"cum_tokens": F.col(tokens)})
    before = F.col("cum_tokens") - F.coalesce(F.col(tokens), F.lit(0))
    return s.withColumn("cum_tokens", F.col("cum_tokens").cast("long")).withColumn(
        "batch_status", F.when(before <= cap, F.lit("processed")).otherwise(F.lit("pending")))


# ---------------------------------------------------------------- W5

def failure_runs(calls: DataFrame, threshold: int, order: list[str], by: str = "program_id",
                 ident: str = "event_id") -> DataFrame:
    """Runs of consecutive failed calls per program reaching ``threshold``.

    A success resets the run, a failure extends it, a refused call
    (``circuit_open``) does neither. Gaps and islands: the island id is the
    running count of successes, so each island holds one run of failures.
    """
    success = F.col("error").isNull()
    failure = F.col("error").isNotNull() & (F.col("error") != REFUSED)
    keep = list(dict.fromkeys([by, *order, ident]))
    narrow = calls.select(*[F.col(f"`{c}`") for c in keep], failure.alias("_fail"),
                          success.cast("long").alias("_ok"))
    s = ordered_scan(narrow, [by], order, sums={"_island": F.col("_ok")})
    o = _ord(order)
    runs = s.filter("_fail").groupBy(by, "_island").agg(
        F.count(F.lit(1)).alias("failures"),
        F.min_by(F.col(f"`{ident}`"), o).alias(f"first_{ident}"),
        F.max_by(F.col(f"`{ident}`"), o).alias(f"last_{ident}"))
    return runs.filter(F.col("failures") >= threshold).select(
        by, F.col("_island").cast("long").alias("successes_before"),
        F.col("failures").cast("long").alias("failures"), f"first_{ident}", f"last_{ident}")


# ---------------------------------------------------------------- R4

def outcomes(attempts: DataFrame, order: list[str], trips: DataFrame | None = None,
             by: str = "program_id") -> DataFrame:
    """Outcome per program from its attempt log.

    budget tripped -> triage/budget; last record a passing match -> parity_pass;
    last record a failing run -> triage/never_ran; last record a failing match
    -> triage/diverged; otherwise (ran, never matched) -> triage/never_ran.
    run_repairs counts run records beyond the first per (outer attempt, step).
    """
    o = _ord(order)
    per = attempts.groupBy(by).agg(
        F.max_by(F.struct("loop", "ok"), o).alias("_last"),
        F.max("outer_attempt").alias("outer_attempts"))
    runs = (attempts.filter(F.col("loop") == "run")
            .groupBy(by, "outer_attempt", "step_index").agg(F.count(F.lit(1)).alias("_n"))
            .groupBy(by).agg(F.sum(F.col("_n") - 1).alias("run_repairs")))
    j = per.join(runs, by, "left")
    tripped = F.lit(False)
    if trips is not None:
        j = j.join(trips.select(by, F.lit(True).alias("_tripped")), by, "left")
        tripped = F.coalesce(F.col("_tripped"), F.lit(False))
    last_loop, last_ok = F.col("_last.loop"), F.col("_last.ok")
    mode = (F.when(tripped, "budget")
             .when((last_loop == "match") & last_ok, F.lit(None))
             .when((last_loop == "run") & ~last_ok, "never_ran")
             .when(last_loop == "match", "diverged")
             .otherwise("never_ran"))
    return j.select(by, F.when(mode.isNull(), "parity_pass").otherwise("triage").alias("status"),
                    mode.alias("failure_mode"),
                    F.col("outer_attempts").cast("long").alias("outer_attempts"),
                    F.coalesce(F.col("run_repairs"), F.lit(0)).cast("long").alias("run_repairs"))


# ---------------------------------------------------------------- R5

def implicated_steps(steps: DataFrame, failed: DataFrame, by: str = "program_id") -> DataFrame:
    """Steps to repair: those whose outputs (case-insensitive) include a failed
    table of their program; a program with no such step gets its highest step.

    steps   program_id, step_index, outputs ARRAY<STRING>
    failed  program_id, table

    ``steps`` is read once: outputs are exploded (steps without outputs
    kept), matched against the failed tables with one left join, and one
    aggregation per program (bounded by its number of steps) picks the hits
    or the fallback.
    """
    f = failed.select(F.col(by).alias("_fp"), F.lower("table").alias("_t")).distinct()
    progs = f.select(F.col("_fp").alias(by)).distinct()
    x = steps.select(by, "step_index", F.explode_outer("outputs").alias("_out"))
    j = x.join(f, (x[by] == f["_fp"]) & (F.lower(x["_out"]) == f["_t"]), "left") \
         .select(x[by].alias(by), "step_index", F.col("_t").isNotNull().alias("_hit"))
    per = j.join(progs, by, "left_semi").groupBy(by).agg(
        F.array_distinct(F.collect_list(F.when(F.col("_hit"), F.col("step_index")))).alias("_hits"),
        F.max("step_index").alias("_last"))
    pick = F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(F.array(F.col("_last")))
    return per.select(by, F.explode(pick).alias("step_index"))


# ---------------------------------------------------------------- R1 R2 R3

def _lines_text(lines: DataFrame, by: str, max_chars: int | None) -> DataFrame:
    """Join ordered lines per program: ``lines`` has by, k (sort struct), line."""
    agg = lines.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    if max_chars:
        text = F.when(F.length(text) > max_chars,
                      F.concat(F.substring(text, 1, max_chars), F.lit("\n...(truncated)"))
                      ).otherwise(text)
    return agg.select(by, text.alias("text"))


def diff_text(tables: DataFrame, columns: DataFrame, samples: DataFrame | None = None,
              by: str = "program_id", max_chars: int | None = None) -> DataFrame:
    """Failure text per program (R2), whole unless ``max_chars`` cuts it.

    tables   by, table, gt_rows, out_rows, missing_rows, extra_rows, passed, error
    columns  by, table, column_name, mismatches, total
    samples  by, table, column_name, sample_no, sample
    """
    head = tables.select(
        by, F.struct("table", F.lit(0).alias("c"), F.lit("").alias("n"), F.lit(0).alias("s")).alias("k"),
        F.format_string("[%s] table %s: ground_truth=%d rows, output=%d rows, missing=%d, extra=%d",
                        F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.col("table"),
                        F.col("gt_rows"), F.col("out_rows"), F.col("missing_rows"),
                        F.col("extra_rows")).alias("line"))
    parts = [head]
    if "error" in tables.columns:
        parts.append(tables.filter(F.col("error").isNotNull()).select(
            by, F.struct("table", F.lit(1).alias("c"), F.lit("").alias("n"), F.lit(0).alias("s")).alias("k"),
            F.concat(F.lit("  error: "), F.col("error")).alias("line")))
    rate = F.col("mismatches") * 100.0 / F.col("total")
    parts.append(columns.filter(F.col("mismatches") > 0).select(
        by, F.struct("table", F.lit(2).alias("c"), F.col("column_name").alias("n"),
                     F.lit(0).alias("s")).alias("k"),
        F.format_string("  column %s: %d/%d mismatched (%.2f%%)", F.col("column_name"),
                        F.col("mismatches"), F.col("total"), rate).alias("line")))
    if samples is not None:
        parts.append(samples.select(
            by, F.struct("table", F.lit(2).alias("c"), F.col("column_name").alias("n"),
                         F.col("sample_no").alias("s")).alias("k"),
            F.concat(F.lit("    sample: "), F.col("sample")).alias("line")))
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    return _lines_text(lines, by, max_chars)


def tol_text(c: Column) -> Column:
    """A tolerance in full: two digits where they say it all."""
    short = F.format_string("%.1e", c)
    return F.when(short.cast("double") == c, short).otherwise(c.cast("string"))


def certificates(programs: DataFrame, outcome: DataFrame, tables: DataFrame,
                 snapshots: DataFrame | None, default_tol: float,
                 certified_at: Column | None = None, by: str = "program_id") -> DataFrame:
    """Parity certificate (markdown) per program.

    programs  by, sas_path, owner, float_rel_tol (NULL -> ``default_tol``)
    outcome   by, outer_attempts, run_repairs
    tables    by, table, gt_rows, out_rows, passed, method
    snapshots by, table, hash
    """
    at = certified_at if certified_at is not None else F.date_format(
        F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    rows = tables.select(by, F.struct(F.col("table")).alias("k"), F.format_string(
        "| %s | %d | %d | %s | %s |", "table", "gt_rows", "out_rows",
        F.when(F.col("passed"), "PASS").otherwise("FAIL"), "method").alias("line"))
    t = _lines_text(rows, by, None).withColumnRenamed("text", "_tables")
    if snapshots is not None:
        snap = snapshots.select(by, F.struct(F.col("table")).alias("k"),
                                F.format_string("- `%s`: `%s`", "table", "hash").alias("line"))
        s = _lines_text(snap, by, None).withColumnRenamed("text", "_snaps")
    else:
        s = programs.select(by, F.lit(None).cast("string").alias("_snaps"))
    j = programs.join(outcome, by, "left").join(t, by, "left").join(s, by, "left")
    tol = F.coalesce(F.col("float_rel_tol"), F.lit(float(default_tol)))
    text = F.concat_ws("\n",
        F.format_string("# Parity certificate: %s", F.col(by)), F.lit(""),
        F.format_string("- program: `%s` (owner %s)", "sas_path", "owner"),
        F.concat(F.lit("- certified at: "), at),
        F.format_string("- outer attempts: %d (run repairs: %d)",
                        F.coalesce("outer_attempts", F.lit(0)), F.coalesce("run_repairs", F.lit(0))),
        F.concat(F.lit("- float relative tolerance: "), tol_text(tol)),
        F.lit("  (keyless comparisons round floats to 10 significant digits before hashing)"),
        # Fixed value: the table's columns.
        F.lit(""), F.lit("| output table | ground-truth rows | output rows | result | method |"),
        F.lit("|---|---|---|---|---|"), F.coalesce(F.col("_tables"), F.lit("")), F.lit(""),
        F.lit("## Input snapshots"), F.coalesce(F.col("_snaps"), F.lit("- (none recorded)")))
    return j.select(by, text.alias("certificate"))


def triage_evidence(outcome: DataFrame, errors: DataFrame, diffs: DataFrame, by: str = "program_id") -> DataFrame:
    """What a triage report shows, by failure mode: the diff text of a program
    that diverged, the last error of any other, or of one without a diff.

    outcome  by, failure_mode
    errors   by, text (the last error)
    diffs    by, text (see ``diff_text``)
    """
    diverged = F.col("failure_mode") == "diverged"
    x = outcome.select(by, "failure_mode").join(errors.select(by, F.col("text").alias("_error")), by, "left") \
        .join(diffs.select(by, F.col("text").alias("_diff")), by, "left")
    return x.select(by, F.coalesce(F.when(diverged, F.col("_diff")), F.col("_error")).alias("text"))


def triage_reports(programs: DataFrame, outcome: DataFrame, evidence: DataFrame,
                   steps: DataFrame | None, filed_at: Column | None = None, by: str = "program_id") -> DataFrame:
    """Triage report (markdown) per program (R3), filed now unless ``filed_at`` says when.

    outcome   by, failure_mode, outer_attempts, run_repairs
    evidence  by, text (see ``triage_evidence``)
    steps     by, step_index, language, code
    """
    at = filed_at if filed_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    if steps is not None:
        fence = F.when(F.col("language") == "pyspark", "python").otherwise(F.col("language"))
        sec = steps.select(by, F.struct("step_index").alias("k"), F.concat(
            F.format_string("### Step %d (%s)\n```", "step_index", "language"), fence,
            F.lit("\n"), F.col("code"), F.lit("\n```")).alias("line"))
        code = _lines_text(sec, by, None).withColumnRenamed("text", "_code")
    else:
        code = programs.select(by, F.lit(None).cast("string").alias("_code"))
    j = (programs.join(outcome, by, "left").join(evidence.withColumnRenamed("text", "_ev"), by, "left")
                 .join(code, by, "left"))
    text = F.concat_ws("\n",
        F.format_string("# Triage report: %s", F.col(by)), F.lit(""),
        F.format_string("- program: `%s` (owner %s)", "sas_path", "owner"),
        F.concat(F.lit("- failure mode: "), F.coalesce("failure_mode", F.lit("unknown"))),
        F.format_string("- outer attempts: %d (run repairs: %d)",
                        F.coalesce("outer_attempts", F.lit(0)), F.coalesce("run_repairs", F.lit(0))),
        F.concat(F.lit("- filed at: "), at),
        F.lit(""), F.lit("## Evidence"), F.lit("```"),
        F.coalesce(F.col("_ev"), F.lit("(no error text)")), F.lit("```"), F.lit(""),
        F.lit("## Closest attempt"), F.coalesce(F.col("_code"), F.lit("(no steps were translated)")))
    return j.select(by, text.alias("report"))


def parity_records(verdicts: DataFrame, attempts: DataFrame, texts: DataFrame, by: str = "program_id") -> DataFrame:
    """The parity results record: one row per program with ``status``
    (``parity_pass`` or ``triage``), ``failure_mode``, ``outer_attempts`` and,
    for a program that failed, its ``report``.

    verdicts  by, passed
    attempts  by, outer_attempts
    texts     by, report
    """
    failed = ~F.coalesce(F.col("passed"), F.lit(False))
    return verdicts.join(attempts, by, "left").join(texts, by, "left").select(
        by, F.when(failed, "triage").otherwise("parity_pass").alias("status"),
        F.when(failed, "diverged").alias("failure_mode"),
        F.coalesce("outer_attempts", F.lit(0)).cast("long").alias("outer_attempts"),
        F.when(failed, F.col("report")).alias("report"))
