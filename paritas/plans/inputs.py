"""Inputs of the registered queries, all read from (or derived by Spark from)
the given parquet tables, so every query's work grows with the data.

The corruption parameters are shared with the SQL oracles in
:mod:`paritas.plans.oracle`, which rebuild the same copies in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.operators.corrupt import corrupt

# Key-modulo parameters of the corrupted copies.
ORDERS_DROP, ORDERS_PERTURB, ORDERS_RELABEL, ORDERS_EXTRA, ORDERS_SWAP = 101, 97, 89, 503, 211
# A copy with few changes, for the re-check by buckets.
RARE_DROP, RARE_PERTURB, RARE_RELABEL, RARE_EXTRA = 997, 1499, 2503, 1999
LINE_DROP, LINE_PERTURB, LINE_RELABEL, LINE_EXTRA = 101, 97, 89, 503

# A row number for lineitem, which has no unique key (l_linenumber < 8).
LINE_ROWKEY = "l_orderkey * 8 + l_linenumber"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_corrupted(orders: DataFrame) -> DataFrame:
    """orders with dropped, perturbed, relabelled, swapped and extra rows."""
    return corrupt(orders, "o_orderkey", drop_mod=ORDERS_DROP,
                   perturb={"o_totalprice": ORDERS_PERTURB},
                   relabel={"o_orderpriority": ORDERS_RELABEL},
                   extra_mod=ORDERS_EXTRA, swap=("o_orderstatus", ORDERS_SWAP))


def orders_slightly_corrupted(orders: DataFrame) -> DataFrame:
    """orders with a changed row among some hundreds."""
    return corrupt(orders, "o_orderkey", drop_mod=RARE_DROP, perturb={"o_totalprice": RARE_PERTURB},
                   relabel={"o_orderpriority": RARE_RELABEL}, extra_mod=RARE_EXTRA)


def lineitem_corrupted(lineitem: DataFrame) -> DataFrame:
    """lineitem with dropped, perturbed, relabelled and duplicated rows."""
    k = F.expr(LINE_ROWKEY)
    base = lineitem.withColumn("_rk", k)
    out = corrupt(base, "_rk", drop_mod=LINE_DROP,
                  perturb={"l_extendedprice": LINE_PERTURB},
                  relabel={"l_returnflag": LINE_RELABEL})
    copies = base.filter(F.col("_rk") % LINE_EXTRA == 0)
    return out.unionByName(copies).drop("_rk")


def lineitem_shuffled(lineitem: DataFrame) -> DataFrame:
    """The same multiset of rows in another physical order and column order."""
    cols = list(reversed(lineitem.columns))
    return lineitem.select(*cols).repartition(7, F.col("l_partkey"))


# Call log, attempt log and status updates derived from events: one program
# per user, the event type as call purpose, value as token cost.
CALL_CAP = 50_000            # per-program token cap
BATCH_CAP = 20_000_000       # per-batch token cap
BREAKER_THRESHOLD = 3        # consecutive failures that open the breaker

EVENT_STATUS = {"signup": "registered", "view": "landed", "click": "translated",
                "purchase": "parity_pass", "error": "triage"}


def call_log(events: DataFrame) -> DataFrame:
    err = F.when(F.col("event_type") == "error",
                 F.when(F.col("event_id") % 5 == 0, F.lit("circuit_open"))
                  .otherwise(F.lit("retries_exhausted")))
    return events.select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("program_id"),
        "user_id", "event_id", "ts", F.lit("m1").alias("model"),
        F.col("event_type").alias("purpose"),
        F.round(F.col("value") * 100).cast("long").alias("input_tokens"),
        (F.col("event_id") % 50).alias("output_tokens"),
        F.round(F.col("value") / 10, 3).alias("latency_s"),
        err.alias("error"))


def attempt_log(events: DataFrame) -> DataFrame:
    loop = F.when(F.col("event_type").isin("purchase", "error"), F.lit("match")).otherwise(F.lit("run"))
    return events.select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("program_id"),
        "event_id", "ts", loop.alias("loop"),
        F.when(loop == "match", F.lit(-1)).otherwise(F.col("event_id") % 3).cast("int").alias("step_index"),
        (F.col("event_id") % 5 + 1).cast("int").alias("outer_attempt"),
        (F.col("event_type") != "error").alias("ok"))


def status_updates(events: DataFrame) -> DataFrame:
    """Key/value rows: key = program, payload = {"status", "event_id"}, at ts."""
    status = F.create_map(*[x for k, v in EVENT_STATUS.items() for x in (F.lit(k), F.lit(v))])
    return events.select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("key"),
        F.to_json(F.struct(status[F.col("event_type")].alias("status"), "event_id")).alias("payload"),
        F.col("ts").cast("timestamp").alias("updated_at"))


# ---------------------------------------------------------------- script corpus
# One SAS program per customer and document (of the same number), which carries
# the document's whole text in a comment block. Include files come from the market segments and the region table.

CORPUS_ROOT = "/corpus/progs"
NL = "\n"


def _opt(cond, text):
    return F.when(cond, text)


def sas_programs(customer: DataFrame, documents: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    ks = k.cast("string")
    seg = F.lower(F.col("c_mktsegment"))
    docs = documents.select(F.col("doc_id"), F.col("text").alias("_doc"))
    c = customer.join(docs, k == F.col("doc_id"), "full").select(
        F.coalesce("c_custkey", "doc_id").alias("c_custkey"), F.coalesce("c_name", F.lit("none")).alias("c_name"),
        F.coalesce("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), "_doc")
    text = F.concat_ws(
        NL,
        F.concat(F.lit("/* program for "), F.col("c_name"), F.lit(" */")),
        _opt(F.col("_doc").isNotNull(), F.concat(F.lit("/* notes:\n"), F.col("_doc"), F.lit("\n*/"))),
        F.lit("options nodate;"),
        F.lit("libname mylib '/data/mylib';"),
        F.concat(F.lit("%let seg = "), F.col("c_mktsegment"), F.lit(";")),
        F.concat(F.lit("%let cutoff = 199"), (k % 10).cast("string"), F.lit("-01-01;")),
        _opt(k % 2 == 0, F.concat(F.lit("%include 'macros/"), seg, F.lit(".sas';"))),
        _opt(k % 10 == 0, F.lit("%include 'missing/nothing.sas';")),
        F.concat(F.lit("data work.c"), ks, F.lit(";")),
        F.lit("  set mylib.orders;"),
        F.concat(F.lit("  where o_custkey = "), ks,
                 F.lit(' and o_orderdate >= "&cutoff."d and seg = "&seg" and code = "&segment_code";')),
        F.lit("run;"),
        _opt(k % 4 == 0, F.lit("%let cutoff = 2000-01-01;")),
        F.lit("proc sql;"),
        F.concat(F.lit("  create table work.s"), ks, F.lit(" as")),
        F.lit("  select o_orderpriority, count(*) as n"),
        F.concat(F.lit("  from work.c"), ks, F.lit(" /* inline */")),
        F.lit("  group by o_orderpriority;"),
        F.lit("quit;"),
        _opt(k % 4 != 0, F.concat(F.lit("proc means data=work.c"), ks, F.lit(" noprint;\n  var o_totalprice;\n"
                                  "  output out=work.m"), ks, F.lit(" mean=avg_price;\nrun;"))),
        _opt(k % 5 == 0, F.concat(F.lit("data work.flag"), ks, F.lit("; set work.c"), ks,
                                  F.lit(";\nproc print data=work.flag"), ks, F.lit("; run;"))),
        _opt(k % 7 == 0, F.concat(F.lit("%macro report"), ks, F.lit("(tbl);\n  proc print data=&tbl; run;\n"
                                  "  data x; set y; run;\n%mend;\n%report"), ks,
                                  F.lit("(work.s"), ks, F.lit(");"))))
    return c.select(F.concat(F.lit("c"), ks).alias("program_id"),
                    F.concat(F.lit(f"{CORPUS_ROOT}/c"), ks, F.lit(".sas")).alias("path"),
                    text.alias("source"))


def sas_include_files(customer: DataFrame, region: DataFrame) -> DataFrame:
    seg = F.lower(F.col("c_mktsegment"))
    macros = customer.select(seg.alias("seg")).distinct().select(
        F.concat(F.lit(f"{CORPUS_ROOT}/macros/"), F.col("seg"), F.lit(".sas")).alias("path"),
        F.concat(F.lit("%macro dedupe_"), F.col("seg"),
                 F.lit("(tbl);\n  proc sort data=&tbl nodupkey; by id; run;\n%mend;\n"
                       "%include 'common/util.sas';\n")).alias("source"))
    util = region.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(f"{CORPUS_ROOT}/macros/common/util.sas").alias("path"),
        F.concat(F.lit("/* shared utilities */\n%let util_version = "), F.col("n").cast("string"),
                 F.lit(";\n")).alias("source"))
    return macros.unionByName(util)


def step_code(orders: DataFrame, documents: DataFrame) -> DataFrame:
    """Generated step code to scan for writes outside the sandbox: one step
    per order and document of the same number, after the document's whole text
    as a comment. Some names and blanks are not ASCII, some steps have no sandbox."""
    docs = documents.select("doc_id", F.regexp_replace("text", r"\*/", "* /").alias("_doc"))
    orders = orders.select("o_orderkey").join(docs, F.col("o_orderkey") == F.col("doc_id"), "full") \
        .select(F.coalesce("o_orderkey", "doc_id").alias("o_orderkey"), "_doc")
    k = F.col("o_orderkey")
    ks = k.cast("string")
    sandbox = F.when(k % 23 != 0, F.concat(F.lit("sandbox_p"), (k % 7).cast("string")))
    own = F.coalesce(sandbox, F.lit("sandbox_p0"))
    m = k % 8
    code = (F.when(m == 0, F.concat(F.lit("CREATE TABLE "), own, F.lit(".t"), ks,
                                    F.lit(" AS SELECT * FROM ground_truth.gt")))
             .when(m == 1, F.concat(F.lit("CREATE TABLE IF NOT EXISTS ground_truth.t"), ks, F.lit(" AS SELECT 1")))
             .when(m == 2, F.concat(F.lit('df.write.saveAsTable(f"staging_inputs.x'), ks, F.lit('")')))
             .when(m == 3, F.concat(F.lit("INSERT INTO `"), own, F.lit("` . `t"), ks, F.lit("` SELECT 1")))
             .when(m == 4, F.concat(F.lit("DROP TABLE -- note\nground_truth.t"), ks))
             .when(m == 5, F.concat(F.lit("CREATE TABLE donn\u00e9es.\u00fcber"), ks, F.lit(" AS SELECT 1")))
             .when(m == 6, F.concat(F.lit("DROP TABLE\u00a0z.t"), ks, F.lit("; DROP TABLE a.t"), ks))
             .otherwise(F.lit("USE staging_inputs")))
    code = F.when(k % 5 == 0, F.concat(code, F.lit('\nspark.catalog.setCurrentDatabase("x")'))).otherwise(code)
    code = F.concat(F.coalesce(F.concat(F.lit("/* "), F.col("_doc"), F.lit(" */\n")), F.lit("")), code)
    return orders.select(F.concat(F.lit("s"), ks).alias("step_id"), sandbox.alias("sandbox"), code.alias("code"))


def sql_scripts(orders: DataFrame, documents: DataFrame) -> DataFrame:
    """SQL scripts, one per order and document of the same number, with the
    document's whole text as a string literal and as plain code."""
    orders = orders.select("o_orderkey", "o_orderpriority").join(documents.select("doc_id", F.col("text").alias("_doc")),
                                                                F.col("o_orderkey") == F.col("doc_id"), "full") \
        .select(F.coalesce("o_orderkey", "doc_id").alias("o_orderkey"), F.coalesce("o_orderpriority", F.lit("none")).alias("o_orderpriority"), "_doc")
    k = F.col("o_orderkey")
    ks = k.cast("string")
    tail = (F.when(k % 3 == 0, F.concat(F.lit("INSERT INTO t VALUES ('O''Brien; "), ks, F.lit("');")))
             .when(k % 3 == 1, F.lit(" ; ;SELECT 2"))
             .otherwise(F.concat(F.lit("SELECT 'open; "), ks)))
    literal = F.coalesce(F.concat(F.lit("SELECT '"), F.replace("_doc", F.lit("'"), F.lit("''")), F.lit("' AS d;\n"),
                                  F.regexp_replace("_doc", "[';]", "~"), F.lit(";\n")), F.lit(""))
    return orders.select(F.concat(F.lit("q"), ks).alias("script_id"), F.concat(
        literal, F.lit("SELECT '"), F.col("o_orderpriority"), F.lit(";"), ks, F.lit("' AS p; "), tail).alias("code"))


def responses(orders: DataFrame, documents: DataFrame, conversations: DataFrame) -> DataFrame:
    """Stored answers, one per order, document and conversation of the same
    number: the whole conversation as prose before the header (in a fence of
    another kind for some), the whole document as a comment in the code block,
    and for some a fence of another kind between header and code."""
    talk = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_t")) \
        .select("conv_id", F.array_join(F.transform("_t", lambda x: F.coalesce(x["text"], F.lit(""))), NL).alias("_talk"))
    x = orders.select("o_orderkey").join(documents.select("doc_id", F.col("text").alias("_doc")), F.col("o_orderkey") == F.col("doc_id"), "full") \
        .select(F.coalesce("o_orderkey", "doc_id").alias("k"), "_doc")
    x = x.join(talk, F.col("k") == F.col("conv_id"), "full").select(F.coalesce("k", "conv_id").alias("k"), "_doc", "_talk")
    k = F.col("k")
    ks = k.cast("string")
    no_fence = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("```"), F.lit("~~~"))
    lang = F.when(k % 7 == 0, "python").when(k % 2 == 1, "pyspark").otherwise("sql")
    prose = F.when(k % 3 == 0, F.concat(F.lit("```text\n"), no_fence("_talk"), F.lit("\n```\n"))) \
        .otherwise(F.concat(no_fence("_talk"), F.lit("\n")))
    header = (F.when(k % 11 == 0, F.lit(""))
               .when(k % 13 == 0, F.lit("```json\n{language: sql\n```\n"))
               .otherwise(F.concat(F.lit('```json\n{"language": "'), lang, F.lit('", "inputs": ["in'), ks,
                                   F.lit('"], "outputs": ["out'), ks, F.lit('"]}\n```\n'))))
    between = F.when(k % 5 == 0, F.lit("then\n```text\nno code\n```\n")).otherwise(F.lit(""))
    fence = F.when(lang == "sql", "sql").otherwise("python")
    code = F.when(k % 17 == 0, F.lit("no code here")).otherwise(
        F.concat(F.lit("```"), fence, F.lit("\n  /* "), no_fence("_doc"), F.lit(" */ SELECT * FROM in"), ks, F.lit(";  \n```")))
    return x.select(F.concat(F.lit("r"), ks).alias("response_id"), (k % 9).cast("int").alias("step_index"),
                    F.concat(F.lit("Here is the step.\n"), prose, header, between, code).alias("text"))
