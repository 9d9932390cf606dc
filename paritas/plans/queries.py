"""The registered query set: one entry per operator of the coverage list.

Each query takes ``(spark, sf_dir)``, reads the given parquet tables and
returns a DataFrame whose columns are aliased exactly like its SQL oracle in
:mod:`paritas.plans.oracle`. Queries may run a few tiny driver-side actions
(e.g. choosing the keyed or keyless path); the heavy work stays lazy.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.operators import compare as C
from paritas.plans import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- phase 1/2
# parity of orders (keyed) and lineitem (keyless)

def _orders_pair(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders")
    return C.align(orders, I.orders_corrupted(orders))


@register("parity_keyed_counts")
def parity_keyed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed verdict of orders against its corrupted copy."""
    return C.keyed_summary(_orders_pair(spark, sf_dir), ["o_orderkey"])


@register("parity_keyed_columns")
def parity_keyed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4/P5: per-column mismatch counts and rate (relative tolerance 1e-9)."""
    a = _orders_pair(spark, sf_dir)
    cols = C.keyed_columns(C.keyed_stats(a, ["o_orderkey"]), a, ["o_orderkey"])
    return cols.withColumn("rate", F.round("rate", 6))


@register("mismatch_samples")
def mismatch_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: first five mismatching rows per column, by key."""
    return C.keyed_samples(_orders_pair(spark, sf_dir), ["o_orderkey"], sample_limit=5)


@register("duplicate_keys")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: (l_orderkey, l_linenumber) values occurring more than once."""
    li = I.table(spark, sf_dir, "lineitem")
    return C.duplicate_keys(li, ["l_orderkey", "l_linenumber"])


@register("parity_keyless_counts")
def parity_keyless_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 keyless/A3/J2: multiset verdict of lineitem against its corrupted copy."""
    li = I.table(spark, sf_dir, "lineitem")
    return C.keyless_summary(C.align(li, I.lineitem_corrupted(li)))


@register("parity_keyed_duplicates")
def parity_keyed_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3/A2: verdict on keys that repeat, whose rows are compared as multisets."""
    li = I.table(spark, sf_dir, "lineitem")
    return C.keyed_summary(C.align(li, I.lineitem_corrupted(li)), ["l_orderkey", "l_linenumber"])


@register("grouped_shared_keys")
def grouped_shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: programs (line numbers) whose tables share key values."""
    li = I.table(spark, sf_dir, "lineitem")
    a, keys = C.align(li, I.lineitem_corrupted(li)), ["l_linenumber", "l_orderkey"]
    s = C.grouped_keyed_stats(a, keys, "l_linenumber")
    cells = sum((F.col("mm__" + n) for n in C.value_columns(a, keys)), F.lit(0)).cast("long")
    return s.select(F.col("l_linenumber").alias("program_id"), "gt_rows", "out_rows", "missing_rows", "extra_rows",
                    "matched_rows", cells.alias("mismatched_cells"), C.stats_passed(a, keys).alias("passed"))


@register("parity_integer_ids")
def parity_integer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long ids against decimal(20,0) ids that differ after the tenth
    digit, as a value (keyed and keyless) and as the key itself."""
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") + F.lit(123456789012000000)).alias("id"))
    moved = F.when(F.col("o_orderkey") % 97 == 0, F.lit(800_000_000)).otherwise(F.lit(0))
    other = orders.select("o_orderkey", (F.col("id") + moved).cast("decimal(20,0)").alias("id"))
    a, b = C.align(orders, other), C.align(orders.select("id"), other.select("id"), ["id"])
    cols = ["gt_rows", "out_rows", "missing_rows", "extra_rows", "mismatched_cells", "passed"]
    part = lambda name, df: df.select(F.lit(name).alias("method"), *cols)
    return part("keyed", C.keyed_summary(a, ["o_orderkey"])) \
        .unionByName(part("keyless", C.keyless_summary(a).withColumn("mismatched_cells", F.lit(0).cast("long")))) \
        .unionByName(part("ids as keys", C.keyed_summary(b, ["id"])))


@register("missing_rows")
def missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem rows absent from the corrupted copy (multiset difference)."""
    li = I.table(spark, sf_dir, "lineitem")
    return C.missing_rows(li, I.lineitem_corrupted(li))


@register("extra_rows")
def extra_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the corrupted lineitem copy absent from lineitem."""
    li = I.table(spark, sf_dir, "lineitem")
    return C.extra_rows(li, I.lineitem_corrupted(li))


@register("program_verdicts")
def program_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2/V3: one program comparing three table pairs; per-table and program verdict.

    orders vs corrupted (keyed, fails), customer vs itself (keyed, passes),
    lineitem vs a reshuffled copy (keyless, passes).
    """
    orders = I.table(spark, sf_dir, "orders")
    customer = I.table(spark, sf_dir, "customer")
    li = I.table(spark, sf_dir, "lineitem")
    parts = [
        ("orders", C.keyed_summary(C.align(orders, I.orders_corrupted(orders)), ["o_orderkey"]),
         "keyed rel_tol=1e-09"),
        ("customer", C.keyed_summary(C.align(customer, customer.select(*reversed(customer.columns))),
                                     ["c_custkey"]), "keyed rel_tol=1e-09"),
        ("lineitem", C.keyless_summary(C.align(li, I.lineitem_shuffled(li))), C.KEYLESS_METHOD),
    ]
    rows = None
    for name, df, method in parts:
        part = df.select(F.lit(name).alias("table_name"), F.lit(method).alias("method"),
                         "gt_rows", "out_rows", "missing_rows", "extra_rows", "passed")
        rows = part if rows is None else rows.unionByName(part)
    from pyspark.sql.window import Window
    rows = rows.select(F.lit("p_tpch").alias("program_id"), "*")
    # Program verdict: every table of the program passed (a window per
    # program, whose size is its number of tables).
    per_program = Window.partitionBy("program_id")
    return rows.withColumn("program_passed", F.bool_and("passed").over(per_program))


# ---------------------------------------------------------------- phase 3
# landing: SAS dates, missing values, fingerprints

from paritas.functions import sas as S  # noqa: E402
from paritas.operators import sas as SO  # noqa: E402
from paritas.sources.landing import normalize_frame  # noqa: E402
from paritas.sources.snapshot import content_digest as _digest  # noqa: E402


def _sas_day_inputs(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    day = S.sas_day_from_date("o_orderdate").cast("double")
    whole = day.cast("long").cast("string")
    return orders.select(
        k.alias("o_orderkey"),
        F.when(k % 13 == 0, F.lit(None)).when(k % 7 == 0, day + 0.75)
         .when(k % 11 == 0, -day - 0.5).otherwise(day).alias("sas_day"),
        F.when(k % 5 == 0, F.lit("n/a")).when(k % 3 == 0, F.concat(F.lit(" "), whole, F.lit(" ")))
         .otherwise(whole).alias("sas_text"))


@register("sas_dates")
def sas_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAS day numbers (with fractions, negatives, missing, text and junk
    injected by key) to ISO dates, and back to day numbers."""
    d = _sas_day_inputs(I.table(spark, sf_dir, "orders"))
    iso = S.sas_date_to_iso("sas_day")
    return d.select("o_orderkey", iso.alias("iso_date"),
                    S.sas_date_to_iso("sas_text").alias("iso_from_text"),
                    S.sas_day_from_date(F.to_date(iso)).alias("back_day"))


def _customer_raw(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        "c_custkey",
        F.when(k % 13 == 0, F.lit(".")).when(k % 17 == 0, F.lit(""))
         .when(k % 5 == 0, F.concat("c_name", F.lit("   ")))
         .when(k % 19 == 0, F.concat("c_name", F.lit("\t \n"))).otherwise(F.col("c_name")).alias("c_name"),
        "c_nationkey",
        F.when(k % 11 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 7 == 0, F.lit(" .")).when(k % 23 == 0, F.lit("   "))
         .otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


@register("normalized_customer")
def normalized_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded, blank, '.' and NaN values injected by key, then landed."""
    return normalize_frame(_customer_raw(I.table(spark, sf_dir, "customer")))


from paritas.plans.oracle import DIGEST_TABLES  # noqa: E402,F401


@register("content_digest")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 (scalable mode): order-insensitive fingerprint per table, over every column."""
    out = None
    for name, cols in DIGEST_TABLES.items():
        d = _digest(I.table(spark, sf_dir, name).select(*cols)).select(
            F.lit(name).alias("table_name"), "*")
        out = d if out is None else out.unionByName(d)
    return out


# ---------------------------------------------------------------- phase 4
# SAS DATA step and PROC operators

EVENT_ORDER = ["ts", "event_id"]


@register("first_last")
def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIRST./LAST. flags of events BY user_id in time order."""
    ev = I.table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return SO.first_last(ev, ["user_id"], EVENT_ORDER).select(
        "event_id", "user_id", "first_user_id", "last_user_id")


@register("first_last_2level")
def first_last_2level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 with two BY variables: FIRST./LAST. of event_type and of user_id within it."""
    ev = I.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return SO.first_last(ev, ["event_type", "user_id"], EVENT_ORDER).select(
        "event_id", "first_event_type", "last_event_type", "first_user_id", "last_user_id")


@register("retain_locf")
def retain_locf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RETAIN of the last non-missing value and a sum statement, BY user_id."""
    ev = I.table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("value")).alias("value_in"))
    out = SO.data_step(ev, ["user_id"], EVENT_ORDER, retain={"retained": "value_in"},
                       sums={"running_total": F.col("value_in")})
    return out.select("event_id", "user_id", "value_in", "retained",
                      F.round("running_total", 6).alias("running_total"))


@register("nodupkey")
def nodupkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PROC SORT NODUPKEY BY l_orderkey, first by l_linenumber."""
    return SO.nodupkey(I.table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber"])


MEANS_OUT = {"n_acctbal": ("n", "c_acctbal"), "mean_acctbal": ("mean", "c_acctbal"),
             "std_acctbal": ("std", "c_acctbal"), "min_acctbal": ("min", "c_acctbal"),
             "max_acctbal": ("max", "c_acctbal")}


@register("proc_means_types")
def proc_means_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PROC MEANS OUTPUT with _TYPE_/_FREQ_ over CLASS c_mktsegment c_nationkey."""
    out = SO.proc_means_output(I.table(spark, sf_dir, "customer"),
                               ["c_mktsegment", "c_nationkey"], MEANS_OUT)
    return out.withColumn("mean_acctbal", F.round("mean_acctbal", 6)) \
              .withColumn("std_acctbal", F.round("std_acctbal", 6))


@register("proc_means_table")
def proc_means_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default statistics n, mean, std, min, max of two variables by class."""
    li = I.table(spark, sf_dir, "lineitem")
    out = SO.proc_means(li, ["l_quantity", "l_extendedprice"], ["l_returnflag"])
    for c in out.columns:
        if c.endswith("_mean") or c.endswith("_std"):
            out = out.withColumn(c, F.round(c, 6))
    return out


@register("freq_oneway")
def freq_oneway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-way frequency table of o_custkey with cumulative columns."""
    f = SO.proc_freq(I.table(spark, sf_dir, "orders"), "o_custkey")
    return f.select("o_custkey", "frequency", F.round("percent", 6).alias("percent"),
                    "cum_frequency", F.round("cum_percent", 6).alias("cum_percent"))


@register("freq_twoway")
def freq_twoway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-way table l_returnflag x l_linestatus."""
    f = SO.proc_freq_2way(I.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return f.select("l_returnflag", "l_linestatus", "frequency",
                    *[F.round(c, 6).alias(c) for c in ("percent", "row_percent", "col_percent")])


@register("transpose_wide")
def transpose_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: PROC TRANSPOSE BY l_orderkey ID l_linenumber VAR l_quantity."""
    return SO.transpose_wide(I.table(spark, sf_dir, "lineitem"), ["l_orderkey"],
                             "l_linenumber", "l_quantity", let=True)


@register("transpose_long")
def transpose_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: wide to long, BY o_orderkey VAR o_totalprice o_custkey."""
    return SO.transpose_long(I.table(spark, sf_dir, "orders"), ["o_orderkey"],
                             ["o_totalprice", "o_custkey"])


@register("merge_by")
def merge_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MERGE orders (one) lineitem (many) BY orderkey; status from the right."""
    o = I.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    li = I.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_linestatus").alias("status"),
        "l_linenumber", "l_quantity")
    return SO.merge_by(o, li, ["orderkey"])


def _orders_with_missing(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(
        "o_orderkey", "o_orderstatus",
        F.when(k % 9 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("price_m"),
        F.when(k % 10 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("prio_m"),
        F.when(k % 8 == 0, F.lit(None)).otherwise(F.col("o_orderdate")).alias("date_m"),
        F.when(k % 4 == 0, F.concat("o_orderpriority", F.lit("  "))).otherwise(F.col("o_orderpriority"))
         .alias("prio_padded"), "o_orderpriority",
        F.when(k % 6 == 0, F.lit("x")).otherwise(F.col("o_totalprice").cast("string")).alias("price_text"))


@register("sas_sort_rank")
def sas_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: position of every order in PROC SORT order
    ``BY prio_m DESCENDING price_m o_orderkey`` (missing lowest)."""
    m = _orders_with_missing(I.table(spark, sf_dir, "orders")).select(
        "o_orderkey", "prio_m",
        F.col("price_m").isNull().cast("int").alias("_price_missing"),
        (-F.col("price_m")).alias("_neg_price"))
    from paritas.operators.scan import ordered_scan
    ranked = ordered_scan(m, [], ["prio_m", "_price_missing", "_neg_price", "o_orderkey"],
                          position="sort_position")
    return ranked.select("o_orderkey", "sort_position")


@register("sas_predicates")
def sas_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing-aware comparisons, blank-insensitive text equality and
    explicit numeric conversion, counted per o_orderstatus."""
    m = _orders_with_missing(I.table(spark, sf_dir, "orders"))
    t = F.lit(250000.0)
    nul = F.lit(None).cast("double")
    return m.groupBy("o_orderstatus").agg(
        F.count_if(S.sas_lt("price_m", t)).alias("n_lt"),
        F.count_if(S.sas_le("price_m", t)).alias("n_le"),
        F.count_if(S.sas_gt("price_m", t)).alias("n_gt"),
        F.count_if(S.sas_ge("price_m", t)).alias("n_ge"),
        F.count_if(S.sas_eq("price_m", nul)).alias("n_eq_missing"),
        F.count_if(S.sas_ne("price_m", nul)).alias("n_ne_missing"),
        F.count_if(S.sas_lt("prio_m", F.lit("2"))).alias("n_prio_lt_2"),
        F.count_if(S.sas_text_eq("prio_padded", "o_orderpriority")).alias("n_text_eq"),
        F.count_if(F.col("prio_padded") == F.col("o_orderpriority")).alias("n_plain_eq"),
        F.count(S.to_sas_num("price_text")).alias("n_numeric"))


def _etl_filtered(spark, sf_dir) -> DataFrame:
    m = _orders_with_missing(I.table(spark, sf_dir, "orders"))
    # data work.filtered; set orders; where date_m >= "1995-01-01"d; run;
    return SO.where_sas(m, "date_m", ">=", F.lit("1995-01-01").cast("timestamp_ntz"))


@register("etl_summary")
def etl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 + A6: the DATA step WHERE then PROC SQL count by priority."""
    return SO.proc_sql_count(_etl_filtered(spark, sf_dir), ["o_orderpriority"], "n")


@register("etl_stats")
def etl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PROC MEANS NOPRINT; VAR price; OUTPUT OUT=stats MEAN=avg_totalprice."""
    out = SO.proc_means_output(_etl_filtered(spark, sf_dir), [],
                               {"avg_totalprice": ("mean", "price_m")})
    return out.withColumn("avg_totalprice", F.round("avg_totalprice", 6))


# ---------------------------------------------------------------- phase 5
# state tables and reports over logs derived from events

from paritas.operators import reports as R  # noqa: E402
from paritas.operators import state as ST  # noqa: E402

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
STATE_SPLIT = "2024-01-15 00:00:00"


def _state(spark, sf_dir) -> DataFrame:
    """Latest state per program after two upsert batches (before/after a cut-off)."""
    upd = I.status_updates(I.table(spark, sf_dir, "events"))
    cut = F.lit(STATE_SPLIT).cast("timestamp")
    first = ST.upsert(None, upd.filter(F.col("updated_at") < cut))
    return ST.upsert(first, upd.filter(F.col("updated_at") >= cut))


def _status(spark, sf_dir) -> DataFrame:
    return _state(spark, sf_dir).select(
        "key", F.get_json_object("payload", "$.status").alias("status"))


@register("latest_state")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: batch upserts of JSON payloads, latest row per key."""
    return _state(spark, sf_dir).select(
        "key", "payload", F.date_format("updated_at", TS_FMT).alias("updated_at"))


@register("pending")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: programs whose latest status is not parity_pass."""
    return ST.pending(_status(spark, sf_dir))


@register("funnel")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs per status."""
    return ST.funnel(_status(spark, sf_dir))


def _calls(spark, sf_dir) -> DataFrame:
    return I.call_log(I.table(spark, sf_dir, "events"))


@register("usage_summary")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, errors, refusals, tokens and latency per program."""
    u = R.usage_summary(_calls(spark, sf_dir), ["program_id"])
    return u.withColumn("avg_latency_s", F.round("avg_latency_s", 6))


@register("migration_metrics")
def migration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rate, triage rate and calls per program."""
    m = R.migration_metrics(_status(spark, sf_dir), _calls(spark, sf_dir))
    return m.select("programs", *[F.round(c, 6).alias(c) for c in
                                  ("pass_rate", "triage_rate", "calls_per_program")])


def _trips(spark, sf_dir) -> DataFrame:
    return R.budget_trips(_calls(spark, sf_dir), I.CALL_CAP, EVENT_ORDER, ident="event_id")


@register("budget_trips")
def budget_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First call per program whose cumulative tokens exceed the cap."""
    return _trips(spark, sf_dir)


@register("batch_budget")
def batch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 batch form: programs in order charge one batch cap."""
    per = _calls(spark, sf_dir).groupBy("program_id", "user_id").agg(
        F.sum(F.col("input_tokens") + F.col("output_tokens")).cast("long").alias("tokens"))
    return R.batch_budget(per, I.BATCH_CAP, ["user_id"]).select(
        "program_id", "tokens", "cum_tokens", "batch_status")


@register("failure_runs")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive failed calls reaching the breaker threshold."""
    return R.failure_runs(_calls(spark, sf_dir), I.BREAKER_THRESHOLD, EVENT_ORDER)


@register("outcomes")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, failure mode, outer attempts and run repairs per program."""
    att = I.attempt_log(I.table(spark, sf_dir, "events"))
    return R.outcomes(att, EVENT_ORDER, trips=_trips(spark, sf_dir))


def _grouped(spark, sf_dir):
    a = _orders_pair(spark, sf_dir)
    return a, C.grouped_keyed_stats(a, ["o_orderkey"], "o_orderpriority")


def _grouped_verdicts(a, s) -> DataFrame:
    keys = ["o_orderpriority", "o_orderkey"]
    cells = sum((F.col("mm__" + n) for n in C.value_columns(a, keys)), F.lit(0))
    return s.select(F.col("o_orderpriority").alias("program_id"), "gt_rows", "out_rows",
                    "missing_rows", "extra_rows", cells.cast("long").alias("mismatched_cells"),
                    C.stats_passed(a, keys).alias("passed"))


@register("grouped_parity")
def grouped_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 at scale: keyed parity of many programs (here: one per order
    priority) from one shuffle and one aggregation."""
    a, s = _grouped(spark, sf_dir)
    return _grouped_verdicts(a, s)


def _diff_texts(a, group: str, name: Column, max_chars: int | None = None) -> DataFrame:
    """Diff text of every program: orders of ``group``, called ``name``."""
    keys, s = ["o_orderkey"], C.grouped_keyed_stats(a, ["o_orderkey"], group)
    who = [name.alias("program_id"), F.lit("orders").alias("table")]
    tables = s.select(*who, "gt_rows", "out_rows", "missing_rows", "extra_rows", C.stats_passed(a, [group, *keys]).alias("passed"))
    cols = C.grouped_columns(s, a, keys, group).select(*who, "column_name", "mismatches", "total")
    samples = C.grouped_samples(a, keys, group).select(*who, "column_name", "sample_no", "sample")
    return R.diff_text(tables, cols, samples, by="program_id", max_chars=max_chars)


@register("diff_text")
def diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: per-program diff text (header, mismatching columns, five samples each)."""
    return _diff_texts(_orders_pair(spark, sf_dir), "o_orderpriority", F.col("o_orderpriority"))


# ---------------------------------------------------------------- phase 6
# bulk jobs over a corpus of scripts derived from the tables

from paritas.operators import corpus as T  # noqa: E402


def _programs(spark, sf_dir) -> DataFrame:
    return I.sas_programs(I.table(spark, sf_dir, "customer"), I.table(spark, sf_dir, "documents"))


@register("stripped_comments")
def stripped_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block comments removed, the newlines they spanned kept."""
    return _programs(spark, sf_dir).select(
        "program_id", T.strip_block_comments("source").alias("source"))


@register("expanded_lets")
def expanded_lets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """%let variables expanded (last definition wins, longest name first)."""
    return _programs(spark, sf_dir).select("program_id", T.expand_lets("source").alias("source"))


@register("resolved_includes")
def resolved_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """%include inlined recursively; missing files flagged."""
    files = I.sas_include_files(I.table(spark, sf_dir, "customer"), I.table(spark, sf_dir, "region"))
    r = T.resolve_includes(_programs(spark, sf_dir), files)
    return r.select("program_id", "source", "include_error")


@register("script_steps")
def script_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 (with T2, T3, T1 first): programs split into ordered typed steps."""
    files = I.sas_include_files(I.table(spark, sf_dir, "customer"), I.table(spark, sf_dir, "region"))
    steps, _ = T.preprocess(_programs(spark, sf_dir), files)
    return steps


def _step_code(spark, sf_dir) -> DataFrame:
    return I.step_code(I.table(spark, sf_dir, "orders"), I.table(spark, sf_dir, "documents"))


@register("write_targets")
def write_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: writes outside each step's sandbox schema and context changes."""
    return T.sandbox_violations(_step_code(spark, sf_dir), "step_id", "code", "sandbox") \
        .select("step_id", "kind", "detail").distinct()


@register("sandbox_verdicts")
def sandbox_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: one verdict per step, with its first violation in text order."""
    return T.sandbox_verdicts(_step_code(spark, sf_dir), "step_id", "code", "sandbox")


@register("sql_statements")
def sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts split into statements at semicolons outside quotes."""
    s = I.sql_scripts(I.table(spark, sf_dir, "orders"), I.table(spark, sf_dir, "documents"))
    return s.select("script_id", F.posexplode(T.split_sql("code")).alias("stmt_no", "statement"))


@register("parsed_responses")
def parsed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored translation responses, which carry whole conversations and
    documents, parsed into language, code, tables or an error."""
    p = T.parse_responses(I.responses(*(I.table(spark, sf_dir, t) for t in ("orders", "documents", "conversations"))))
    return p.select("response_id", "step_index", "language", "code",
                    F.array_join("inputs", ",").alias("inputs"),
                    F.array_join("outputs", ",").alias("outputs"), "error")


# ---------------------------------------------------------------- R1 / R3 reports

CERTIFIED_AT = "2026-01-01T00:00:00"
#: Evidence in a triage report is cut here.
EVIDENCE_CHARS = 6000


def _segment_programs(spark, sf_dir):
    """One program per market segment: its customers compared with a
    reshuffled copy of themselves (keyed), plus a snapshot digest."""
    from paritas.sources.snapshot import grouped_content_digest
    cust = I.table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    a = C.align(cust, cust.select(*reversed(cust.columns)).repartition(5, "c_nationkey"))
    s = C.grouped_keyed_stats(a, ["c_custkey"], "c_mktsegment")
    tables = s.select(
        seg.alias("program_id"), F.concat(F.lit("sandbox_"), F.lower(seg), F.lit(".customer")).alias("table"),
        "gt_rows", "out_rows", C.stats_passed(a, ["c_mktsegment", "c_custkey"]).alias("passed"),
        F.lit("keyed rel_tol=1e-09").alias("method"))
    programs = cust.groupBy(seg.alias("program_id")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("c_nationkey").alias("_nations"))
    outcome = programs.select("program_id", (F.col("_n") % 3 + 1).cast("long").alias("outer_attempts"),
                              (F.col("_nations") % 4).cast("long").alias("run_repairs"))
    records = programs.select(
        "program_id", F.concat(F.lit("/corpus/progs/seg_"), F.lower("program_id"), F.lit(".sas")).alias("sas_path"),
        F.concat(F.lit("team_"), F.lower("program_id")).alias("owner"),
        F.lit(None).cast("double").alias("float_rel_tol"))
    snaps = grouped_content_digest(cust, "c_mktsegment").select(
        F.col("c_mktsegment").alias("program_id"), F.lit("staging.customer").alias("table"),
        F.col("digest").alias("hash"))
    return records, outcome, tables, snaps


@register("certificates")
def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity certificate text per passing program (one per segment)."""
    records, outcome, tables, snaps = _segment_programs(spark, sf_dir)
    return R.certificates(records, outcome, tables, snaps, 1e-9, F.lit(CERTIFIED_AT))


@register("triage_reports")
def triage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triage report per failing program of the attempt log: failure mode,
    the evidence that fits it, and the latest attempt of each step. A program's
    output is the orders of the customer of its number; those of diverged
    programs are compared, the others show their last error."""
    ev = I.table(spark, sf_dir, "events")
    att = I.attempt_log(ev)
    out = R.outcomes(att, EVENT_ORDER, trips=_trips(spark, sf_dir)).filter(F.col("status") == "triage")
    errors = I.call_log(ev).filter(F.col("error").isNotNull()).groupBy("program_id").agg(
        F.max_by(F.concat(F.lit("call "), F.col("event_id").cast("string"), F.lit(": "), F.col("error")),
                 F.struct(*EVENT_ORDER)).alias("text"))
    diverged = out.filter(F.col("failure_mode") == "diverged").select(F.expr("cast(substring(program_id, 2) as bigint)").alias("o_custkey"))
    orders = I.table(spark, sf_dir, "orders")
    pair = C.align(*(x.join(diverged, "o_custkey", "left_semi").select(orders.columns) for x in (orders, I.orders_corrupted(orders))))
    diffs = _diff_texts(pair, "o_custkey", F.concat(F.lit("p"), F.col("o_custkey").cast("string")), EVIDENCE_CHARS)
    runs = att.filter(F.col("loop") == "run")
    steps = runs.groupBy("program_id", "step_index").agg(
        F.max_by(F.col("event_id"), F.struct(*EVENT_ORDER)).alias("_e")).select(
        "program_id", "step_index", F.lit("sql").alias("language"),
        F.concat(F.lit("SELECT * FROM attempt_"), F.col("_e").cast("string")).alias("code"))
    records = out.select("program_id", F.concat(F.lit("/corpus/progs/"), F.col("program_id"),
                                                F.lit(".sas")).alias("sas_path"),
                         F.lit("migration").alias("owner"))
    return R.triage_reports(records, out.drop("status"), R.triage_evidence(out, errors, diffs), steps, F.lit(CERTIFIED_AT))


# ---------------------------------------------------------------- R5 / K4

# Tables a SAS step writes: DATA targets, CREATE TABLE targets and OUT= data sets.
STEP_OUTPUT_RE = r"(?i)\b(?:data|create\s+table|out\s*=)\s*([\w.]+)"


@register("implicated_steps")
def implicated_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps to repair per program: those writing a failed table
    (case-insensitive), else the program's last step."""
    files = I.sas_include_files(I.table(spark, sf_dir, "customer"), I.table(spark, sf_dir, "region"))
    steps, _ = T.preprocess(_programs(spark, sf_dir), files)
    steps = steps.select("program_id", "step_index",
                         F.regexp_extract_all("code", F.lit(STEP_OUTPUT_RE), 1).alias("outputs"))
    cust = I.table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    failed = cust.select(F.concat(F.lit("c"), k).alias("program_id"), F.explode(F.array(
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("WORK.S"), k)),
        F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("work.missing_"), k)))).alias("table")
    ).filter(F.col("table").isNotNull())
    return R.implicated_steps(steps, failed)


@register("call_log_records")
def call_log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: the call log in append-log shape (JSON payload, timestamp)."""
    calls = I.call_log(I.table(spark, sf_dir, "events")).select(
        "program_id", "event_id", "purpose", "input_tokens", "output_tokens", "error", "ts")
    log = ST.to_log(calls, ts="ts", keep_nulls=True)
    return log.select("payload", F.date_format("ts", TS_FMT).alias("ts"))


# ---------------------------------------------------------------- drivers, sources and state as queries

@register("parity_results")
def parity_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of one program's pairs: keyed, repeated keys
    (multiset fallback), a missing column, another type, and an equal pair."""
    t = lambda name: I.table(spark, sf_dir, name)
    orders, li, cust, nation, supp = t("orders"), t("lineitem"), t("customer"), t("nation"), t("supplier")
    found = C.validate_program(spark, "p_tpch", [
        (orders, I.orders_corrupted(orders), ["o_orderkey"], "orders"),
        (li, I.lineitem_corrupted(li), ["l_orderkey"], "lineitem"),
        (cust, cust.drop("c_acctbal"), ["c_custkey"], "customer"),
        (nation, nation.withColumn("n_name", F.length("n_name")), ["n_nationkey"], "nation"),
        (supp, supp.repartition(3), None, "supplier")])
    return found.frames(spark)[0].withColumnRenamed("table", "table_name")


@register("inventory_parity")
def inventory_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: an inventory of 50 programs in three layouts: orders by customer
    number (keyed, corrupted), order lines (keyless, corrupted) and customers
    (keyed, equal, one program's tables empty), each layout in one plan."""
    from uuid import uuid4

    from paritas.session import shared_dir
    orders, li, cust = (I.table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer"))

    def programs(df: DataFrame, column: str, n: int) -> DataFrame:
        """The table written as one folder per program."""
        path = shared_dir(spark, f"programs-{uuid4().hex}")
        df.withColumn("_p", F.col(column) % n).write.partitionBy("_p").parquet(path)
        return spark.read.parquet(path)

    pairs = []
    for column, prefix, n, g, o, keys in (("o_custkey", "o", 20, orders, I.orders_corrupted(orders), ["o_orderkey"]),
                                          ("l_orderkey", "l", 20, li, I.lineitem_corrupted(li), []),
                                          ("c_custkey", "c", 10, cust, cust.select(*reversed(cust.columns)), ["c_custkey"])):
        sides = [programs(x.where(F.lit(prefix != "c") | (F.col(column) % n != 9)), column, n) for x in (g, o)]
        for i in range(n):
            mine = [x.where(F.col("_p") == i).drop("_p") for x in sides]
            pairs.append(C.Pair(f"{prefix}{i}", f"sandbox_{prefix}{i}.out", *mine, keys, 1e-9))
    tables, columns, samples = C.compare_pairs(spark, pairs)
    cells = columns.groupBy("program_id").agg(F.sum("mismatches").alias("mismatched_cells"))
    shown = samples.groupBy("program_id").agg(F.count(F.lit(1)).alias("n_samples"))
    return tables.join(cells, "program_id", "left").join(shown, "program_id", "left").select(
        "program_id", F.col("table").alias("table_name"), *C.PAIR_COUNTS, "method", "passed", "mismatched_cells",
        F.coalesce("n_samples", F.lit(0)).alias("n_samples"))


@register("csv_source")
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents written as CSV (quotes doubled, line breaks and
    separators inside quotes) and read back through the reader by suffix, which
    finds the types: whole numbers, wide ones, fractions, booleans and texts."""
    from uuid import uuid4

    from paritas.session import shared_dir
    from paritas.sources.readers import read_source
    doc = F.col("doc_id")
    docs = I.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit('"a", b;\n'), F.col("text")).alias("text"), "lang", (doc + 10**12).alias("wide"),
        F.when(doc % 7 != 0, doc / 8).alias("ratio"), (doc % 2 == 0).alias("even"), F.lpad(doc.cast("string"), 3, "x").alias("code"))
    path = shared_dir(spark, f"documents-{uuid4().hex}.csv")
    docs.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    back = read_source(spark, path, multi_line=True)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang", "wide", "ratio", "even", "code")


@register("table_schemas")
def table_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas of the given tables as catalog views, a missing one skipped, and their rows."""
    from paritas.sources.readers import table_schemas as schemas
    names = ["customer", "documents", "embeddings", "events", "lineitem", "orders"]
    for n in names:
        I.table(spark, sf_dir, n).createOrReplaceTempView(f"schemas_{n}")
    rows = [I.table(spark, sf_dir, n).agg(F.lit(f"schemas_{n}").alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for n in names]
    return schemas(spark, [*(f"schemas_{n}" for n in names), "schemas_none"]).join(reduce(DataFrame.unionAll, rows), "table_name")


@register("catalog_parity")
def catalog_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 by name: catalog views compared, keyed and keyless, and a table that is not there."""
    orders, li = I.table(spark, sf_dir, "orders"), I.table(spark, sf_dir, "lineitem")
    for name, df in (("orders", orders), ("orders_out", I.orders_corrupted(orders)), ("lines", li), ("lines_out", I.lineitem_shuffled(li))):
        df.createOrReplaceTempView(f"parity_{name}")
    found = C.validate_program(spark, "p_views", [
        ("parity_orders", "parity_orders_out", ["o_orderkey"]), ("parity_lines", "parity_lines_out", None),
        ("parity_orders", "parity_none", ["o_orderkey"])])
    tables, columns, _ = found.frames(spark)
    mismatches = columns.groupBy("program_id", "table").agg(F.sum("mismatches").alias("mismatched_cells"))
    return tables.join(mismatches, ["program_id", "table"], "left").select(
        "program_id", F.col("table").alias("table_name"), "gt_rows", "out_rows", "missing_rows", "extra_rows", "method", "passed",
        "mismatched_cells", F.col("error").startswith("table access failed: ").alias("inaccessible"))


@register("parquet_snapshot")
def parquet_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table landed once under its digest and read back by suffix."""
    from paritas.session import shared_dir
    from paritas.sources.readers import read_source
    from paritas.sources.snapshot import snapshot
    path, digest = snapshot(read_source(spark, f"{sf_dir.rstrip('/')}/customer.parquet"), "customer", shared_dir(spark, "snapshots"))
    return spark.read.parquet(path).select("c_custkey", "c_name", "c_acctbal", F.lit(digest).alias("digest"))


@register("bucket_recheck")
def bucket_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed verdict of two bucketed snapshots, reading only the
    buckets whose digests differ; equal to the verdict over the whole tables."""
    from paritas.operators.recheck import bucketed_snapshot, recheck
    from paritas.session import shared_dir
    orders, root = I.table(spark, sf_dir, "orders"), shared_dir(spark, "snapshots")
    return recheck(spark, *(bucketed_snapshot(df, "orders", root, ["o_orderkey"]) for df in (orders, I.orders_slightly_corrupted(orders))))


@register("inventory_status")
def inventory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5/K6: programs (one per customer) registered in two goes, then set to
    the status that their last order stands for."""
    cust = I.table(spark, sf_dir, "customer")
    progs = cust.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("program_id"),
                        F.col("c_name").alias("owner"), "c_custkey")
    inv, _ = ST.register(None, progs.where("c_custkey % 3 <> 0"))
    inv, _ = ST.register(inv, progs)
    last = I.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    known = last.join(cust.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    status = F.element_at(F.array(*[F.lit(x) for x in ST.STATUSES]), (F.col("k") % len(ST.STATUSES) + 1).cast("int"))
    up = known.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("program_id"), status.alias("status"),
                      F.when(status == "triage", F.concat(F.lit("order "), F.col("k").cast("string"))).alias("error"))
    return ST.set_status(inv, up).select("program_id", "owner", "status", "error")


@register("log_scan")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3/O3: the call log read back in time order, payload parsed."""
    calls = I.call_log(I.table(spark, sf_dir, "events")).select("program_id", "event_id", "purpose", "error", "ts")
    out = ST.scan(ST.to_log(calls, ts="ts", keep_nulls=True), "program_id string, event_id bigint, purpose string, error string")
    return out.select("program_id", "event_id", "purpose", "error", F.date_format("ts", TS_FMT).alias("ts"))


@register("program_state")
def program_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the newest payload of one program, by key."""
    kv = ST.latest_by_time(I.status_updates(I.table(spark, sf_dir, "events")))
    return ST.get(kv, "p7", "status string, event_id bigint")


@register("sas_top")
def sas_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: the first 500 customers in SAS order (missing, NaN included, lowest)."""
    raw = _customer_raw(I.table(spark, sf_dir, "customer"))
    top = SO.sas_sort(raw, ["c_acctbal", ("c_custkey", "desc")]).limit(500)
    return top.select("c_custkey", F.when(F.isnan("c_acctbal"), F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"))


@register("parity_records")
def parity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One results record per program (order priority): status, failure
    mode, attempts and, where it failed, its whole diff text."""
    a, s = _grouped(spark, sf_dir)
    verdicts = _grouped_verdicts(a, s)
    text = diff_text(spark, sf_dir).withColumnRenamed("text", "report")
    attempts = verdicts.select("program_id", (F.col("gt_rows") % 4 + 1).cast("long").alias("outer_attempts"))
    return R.parity_records(verdicts.select("program_id", "passed"), attempts, text)
