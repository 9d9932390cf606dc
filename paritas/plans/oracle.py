"""DuckDB SQL oracles for the registered queries.

Each string runs on views named after the given parquet tables and must give
the same rows (order-insensitive), column names and values as the Spark
query of the same name. The corrupted copies are rebuilt here in SQL from the
same modulo parameters (:mod:`paritas.plans.inputs`).
"""

from __future__ import annotations

from paritas.plans import inputs as I

ORACLE: dict[str, str] = {}

TOL = "1e-9"


def fmatch(a: str, b: str) -> str:
    """SQL twin of values_match for floats."""
    return (f"(({a}) IS NOT DISTINCT FROM ({b}) OR coalesce(isfinite({a}) AND isfinite({b}) "
            f"AND abs(({a}) - ({b})) <= greatest(greatest(abs({a}), abs({b})) * {TOL}, 1e-12), false))")


def ematch(a: str, b: str) -> str:
    return f"(({a}) IS NOT DISTINCT FROM ({b}))"


# ----------------------------------------------------------------- inputs

ORDERS_BAD = f"""
orders_sw AS (
  SELECT o_orderkey AS _pair, o_orderkey + 1 AS _sk, o_orderstatus AS _sv
  FROM orders WHERE o_orderkey % {I.ORDERS_SWAP} = 0
  UNION ALL
  SELECT o_orderkey - 1, o_orderkey - 1, o_orderstatus
  FROM orders WHERE o_orderkey % {I.ORDERS_SWAP} = 1),
orders_swaps AS (
  SELECT _sk, _sv FROM orders_sw
  WHERE _pair IN (SELECT _pair FROM orders_sw GROUP BY _pair HAVING count(*) = 2)),
orders_bad AS (
  SELECT x.o_orderkey, x.o_custkey,
         CASE WHEN s._sk IS NOT NULL THEN s._sv ELSE x.o_orderstatus END AS o_orderstatus,
         CASE WHEN x.o_orderkey % {I.ORDERS_PERTURB} = 0 THEN x.o_totalprice + 1.0
              ELSE x.o_totalprice END AS o_totalprice,
         x.o_orderdate,
         CASE WHEN x.o_orderkey % {I.ORDERS_RELABEL} = 0 THEN x.o_orderpriority || '*'
              ELSE x.o_orderpriority END AS o_orderpriority
  FROM orders x LEFT JOIN orders_swaps s ON x.o_orderkey = s._sk
  WHERE x.o_orderkey % {I.ORDERS_DROP} <> 0
  UNION ALL
  SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % {I.ORDERS_EXTRA} = 0)"""

LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
             "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
             "l_shipdate"]
_RK = "(l_orderkey * 8 + l_linenumber)"

LINEITEM_BAD = f"""
lineitem_bad AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
         CASE WHEN {_RK} % {I.LINE_PERTURB} = 0 THEN l_extendedprice + 1.0
              ELSE l_extendedprice END AS l_extendedprice,
         l_discount, l_tax,
         CASE WHEN {_RK} % {I.LINE_RELABEL} = 0 THEN l_returnflag || '*'
              ELSE l_returnflag END AS l_returnflag,
         l_linestatus, l_shipdate
  FROM lineitem WHERE {_RK} % {I.LINE_DROP} <> 0
  UNION ALL
  SELECT {', '.join(LINE_COLS)} FROM lineitem WHERE {_RK} % {I.LINE_EXTRA} = 0)"""

ORDER_VALS = [("o_custkey", False), ("o_orderdate", False), ("o_orderpriority", False),
              ("o_orderstatus", False), ("o_totalprice", True)]

ORDERS_JOIN = "orders_j AS (SELECT g.o_orderkey AS gk, b.o_orderkey AS bk, " + ", ".join(
    f"g.{c} AS g_{c}, b.{c} AS b_{c}" for c, _ in ORDER_VALS) + \
    " FROM orders g FULL OUTER JOIN orders_bad b ON g.o_orderkey IS NOT DISTINCT FROM b.o_orderkey)"


def _orders_match(c: str, is_float: bool) -> str:
    return (fmatch if is_float else ematch)(f"g_{c}", f"b_{c}")


_MATCHED = "gk IS NOT NULL AND bk IS NOT NULL"
_CELLS = " + ".join(f"count(*) FILTER (WHERE {_MATCHED} AND NOT {_orders_match(c, f)})"
                    for c, f in ORDER_VALS)

ORDERS_SUMMARY = f"""
orders_summary AS (
  SELECT CAST(count(*) FILTER (WHERE gk IS NOT NULL) AS BIGINT) AS gt_rows,
         CAST(count(*) FILTER (WHERE bk IS NOT NULL) AS BIGINT) AS out_rows,
         CAST(count(*) FILTER (WHERE gk IS NOT NULL AND bk IS NULL) AS BIGINT) AS missing_rows,
         CAST(count(*) FILTER (WHERE bk IS NOT NULL AND gk IS NULL) AS BIGINT) AS extra_rows,
         CAST(count(*) FILTER (WHERE {_MATCHED}) AS BIGINT) AS matched_rows,
         CAST({_CELLS} AS BIGINT) AS mismatched_cells
  FROM orders_j)"""

ORACLE["parity_keyed_counts"] = f"""
WITH {ORDERS_BAD}, {ORDERS_JOIN}, {ORDERS_SUMMARY}
SELECT *, (gt_rows = out_rows AND missing_rows = 0 AND extra_rows = 0
           AND mismatched_cells = 0) AS passed
FROM orders_summary"""

ORACLE["bucket_recheck"] = f"""
WITH orders_bad AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % {I.RARE_PERTURB} = 0 THEN o_totalprice + 1.0 ELSE o_totalprice END AS o_totalprice,
    o_orderdate, CASE WHEN o_orderkey % {I.RARE_RELABEL} = 0 THEN o_orderpriority || '*' ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % {I.RARE_DROP} <> 0
  UNION ALL
  SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % {I.RARE_EXTRA} = 0),
{ORDERS_JOIN}, {ORDERS_SUMMARY}
SELECT *, (gt_rows = out_rows AND missing_rows = 0 AND extra_rows = 0 AND mismatched_cells = 0) AS passed FROM orders_summary"""

ORACLE["parity_keyed_columns"] = f"WITH {ORDERS_BAD}, {ORDERS_JOIN}\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name,
       CAST(count(*) FILTER (WHERE {_MATCHED} AND NOT {_orders_match(c, f)}) AS BIGINT) AS mismatches,
       CAST(count(*) FILTER (WHERE {_MATCHED}) AS BIGINT) AS total,
       round(CASE WHEN count(*) FILTER (WHERE {_MATCHED}) > 0
                  THEN count(*) FILTER (WHERE {_MATCHED} AND NOT {_orders_match(c, f)})
                       / count(*) FILTER (WHERE {_MATCHED}) ELSE 0.0 END, 6) AS rate
FROM orders_j""" for c, f in ORDER_VALS)

ORACLE["mismatch_samples"] = f"""
WITH {ORDERS_BAD}, {ORDERS_JOIN},
bad AS (""" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, gk AS o_orderkey, CAST(g_{c} AS VARCHAR) AS gt_value,
       CAST(b_{c} AS VARCHAR) AS out_value
FROM orders_j WHERE {_MATCHED} AND NOT {_orders_match(c, f)}""" for c, f in ORDER_VALS) + """),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY o_orderkey) AS INTEGER)
            AS sample_no
  FROM bad)
SELECT column_name, sample_no, o_orderkey, gt_value, out_value,
       'o_orderkey=' || CAST(o_orderkey AS VARCHAR) || ': ' || column_name || ' '
       || coalesce(gt_value, 'None') || ' != ' || coalesce(out_value, 'None') AS sample
FROM ranked WHERE sample_no <= 5"""

ORACLE["duplicate_keys"] = """
SELECT l_orderkey, l_linenumber, count(*) AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""

_LINE_ALL = ", ".join(LINE_COLS)
_LINE_ON = " AND ".join(f"gc.{c} IS NOT DISTINCT FROM oc.{c}" for c in LINE_COLS)


def keyless_sql(g: str, o: str, cols: list[str]) -> str:
    """Multiset difference of two relations as one summary row."""
    on = " AND ".join(f"gc.{c} IS NOT DISTINCT FROM oc.{c}" for c in cols)
    allc = ", ".join(cols)
    return f"""(
  WITH gc AS (SELECT {allc}, count(*) AS n FROM {g} GROUP BY ALL),
       oc AS (SELECT {allc}, count(*) AS n FROM {o} GROUP BY ALL),
       j AS (SELECT coalesce(gc.n, 0) AS gn, coalesce(oc.n, 0) AS onn
             FROM gc FULL OUTER JOIN oc ON {on})
  SELECT CAST(sum(gn) AS BIGINT) AS gt_rows, CAST(sum(onn) AS BIGINT) AS out_rows,
         CAST(sum(greatest(gn - onn, 0)) AS BIGINT) AS missing_rows,
         CAST(sum(greatest(onn - gn, 0)) AS BIGINT) AS extra_rows
  FROM j)"""


ORACLE["parity_keyless_counts"] = f"""
WITH {LINEITEM_BAD}
SELECT *, (gt_rows = out_rows AND missing_rows = 0 AND extra_rows = 0) AS passed
FROM {keyless_sql('lineitem', 'lineitem_bad', LINE_COLS)}"""



def repeated_keys_sql(g: str, o: str, keys: list[str], by: str | None) -> str:
    """Keyed verdict with repeated keys: unique keys cell by cell, the others
    by counting equal rows within the key. One row, or one per ``by``."""
    vals = [c for c in LINE_COLS if c not in keys]
    ks, on = ", ".join(keys), lambda x, y: " AND ".join(f"{x}.{k} IS NOT DISTINCT FROM {y}.{k}" for k in keys)
    floats = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    cells = " + ".join(f"CASE WHEN {(fmatch if c in floats else ematch)('g.' + c, 'o.' + c)} THEN 0 ELSE 1 END" for c in vals)
    group, pick = (f" GROUP BY {by}", f"{by} AS program_id, ") if by else ("", "")
    merged = f"""k AS (SELECT {ks}, sum(g) AS gn, sum(o) AS onn FROM (
      SELECT {ks}, 1 AS g, 0 AS o FROM {g} UNION ALL SELECT {ks}, 0, 1 FROM {o}) GROUP BY ALL),
    rows_ AS (SELECT {_LINE_ALL}, sum(g) AS gn, sum(o) AS onn FROM (
      SELECT {_LINE_ALL}, 1 AS g, 0 AS o FROM {g} UNION ALL SELECT {_LINE_ALL}, 0, 1 FROM {o}) GROUP BY ALL),
    parts AS (
      SELECT {ks}, gn AS gt, onn AS ot, CASE WHEN gn < 2 AND onn = 0 THEN 1 ELSE 0 END AS miss,
        CASE WHEN onn < 2 AND gn = 0 THEN 1 ELSE 0 END AS extra,
        CASE WHEN gn = 1 AND onn = 1 THEN 1 ELSE 0 END AS hit, 0 AS cells FROM k
      UNION ALL
      SELECT {", ".join("r." + k for k in keys)}, 0, 0, greatest(r.gn - r.onn, 0), greatest(r.onn - r.gn, 0), least(r.gn, r.onn), 0
      FROM rows_ r JOIN k ON {on("r", "k")} WHERE k.gn > 1 OR k.onn > 1
      UNION ALL
      SELECT {", ".join("k." + x for x in keys)}, 0, 0, 0, 0, 0, {cells}
      FROM k JOIN {g} g ON {on("k", "g")} JOIN {o} o ON {on("k", "o")} WHERE k.gn = 1 AND k.onn = 1)"""
    big = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {n}" for c, n in (
        ("gt", "gt_rows"), ("ot", "out_rows"), ("miss", "missing_rows"), ("extra", "extra_rows"), ("hit", "matched_rows"),
        ("cells", "mismatched_cells")))
    return f"""{merged}
SELECT *, gt_rows = out_rows AND missing_rows = 0 AND extra_rows = 0 AND mismatched_cells = 0 AS passed
FROM (SELECT {pick}{big} FROM parts{group})"""


ORACLE["parity_keyed_duplicates"] = f"WITH {LINEITEM_BAD}, " + repeated_keys_sql(
    "lineitem", "lineitem_bad", ["l_orderkey", "l_linenumber"], None)
ORACLE["grouped_shared_keys"] = f"WITH {LINEITEM_BAD}, " + repeated_keys_sql(
    "lineitem", "lineitem_bad", ["l_linenumber", "l_orderkey"], "l_linenumber")

# Ids of 18 digits; every 97th differs in the last ones.
ORACLE["parity_integer_ids"] = """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 97 = 0) AS bad FROM orders)
SELECT 'keyed' AS method, n AS gt_rows, n AS out_rows, CAST(0 AS BIGINT) AS missing_rows, CAST(0 AS BIGINT) AS extra_rows,
  bad AS mismatched_cells, bad = 0 AS passed FROM n
UNION ALL
SELECT 'keyless', n, n, bad, bad, CAST(0 AS BIGINT), bad = 0 FROM n
UNION ALL
SELECT 'ids as keys', n, n, bad, bad, CAST(0 AS BIGINT), bad = 0 FROM n"""

ORACLE["missing_rows"] = f"""
WITH {LINEITEM_BAD}
SELECT {_LINE_ALL} FROM lineitem EXCEPT ALL SELECT {_LINE_ALL} FROM lineitem_bad"""

ORACLE["extra_rows"] = f"""
WITH {LINEITEM_BAD}
SELECT {_LINE_ALL} FROM lineitem_bad EXCEPT ALL SELECT {_LINE_ALL} FROM lineitem"""

_CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_CUST_CELLS = " + ".join(
    f"count(*) FILTER (WHERE a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL AND NOT "
    f"{(fmatch if c == 'c_acctbal' else ematch)('a.' + c, 'b.' + c)})"
    for c in _CUST_COLS[1:])

ORACLE["program_verdicts"] = f"""
WITH {ORDERS_BAD}, {ORDERS_JOIN}, {ORDERS_SUMMARY},
cust AS (
  SELECT CAST(count(a.c_custkey) AS BIGINT) AS gt_rows, CAST(count(b.c_custkey) AS BIGINT) AS out_rows,
         CAST(count(*) FILTER (WHERE b.c_custkey IS NULL) AS BIGINT) AS missing_rows,
         CAST(count(*) FILTER (WHERE a.c_custkey IS NULL) AS BIGINT) AS extra_rows,
         CAST({_CUST_CELLS} AS BIGINT) AS cells
  FROM customer a FULL OUTER JOIN customer b ON a.c_custkey IS NOT DISTINCT FROM b.c_custkey),
li AS (SELECT * FROM {keyless_sql('lineitem', 'lineitem', LINE_COLS)}),
t AS (
  SELECT 'orders' AS table_name, 'keyed rel_tol=1e-09' AS method, gt_rows, out_rows,
         missing_rows, extra_rows,
         (gt_rows = out_rows AND missing_rows = 0 AND extra_rows = 0 AND mismatched_cells = 0)
           AS passed
  FROM orders_summary
  UNION ALL
  SELECT 'customer', 'keyed rel_tol=1e-09', gt_rows, out_rows, missing_rows, extra_rows,
         (gt_rows = out_rows AND missing_rows = 0 AND extra_rows = 0 AND cells = 0)
  FROM cust
  UNION ALL
  SELECT 'lineitem', 'keyless-hash(%.9e)', gt_rows, out_rows, missing_rows, extra_rows,
         (gt_rows = out_rows AND missing_rows = 0 AND extra_rows = 0)
  FROM li)
SELECT 'p_tpch' AS program_id, *, (min(CAST(passed AS INTEGER)) OVER () = 1) AS program_passed
FROM t"""


# ---------------------------------------------------------------- phase 3

_DAY = "CAST(datediff('day', DATE '1960-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE)"


def _iso(x: str) -> str:
    return f"strftime(DATE '1960-01-01' + CAST(trunc({x}) AS INTEGER), '%Y-%m-%d')"


ORACLE["sas_dates"] = f"""
WITH d AS (SELECT o_orderkey AS k, {_DAY} AS day FROM orders),
s AS (
  SELECT k,
         CASE WHEN k % 13 = 0 THEN NULL WHEN k % 7 = 0 THEN day + 0.75
              WHEN k % 11 = 0 THEN -day - 0.5 ELSE day END AS sas_day,
         CASE WHEN k % 5 = 0 THEN 'n/a'
              WHEN k % 3 = 0 THEN ' ' || CAST(CAST(day AS BIGINT) AS VARCHAR) || ' '
              ELSE CAST(CAST(day AS BIGINT) AS VARCHAR) END AS sas_text
  FROM d)
SELECT k AS o_orderkey, {_iso('sas_day')} AS iso_date,
       {_iso('TRY_CAST(sas_text AS DOUBLE)')} AS iso_from_text,
       CAST(datediff('day', DATE '1960-01-01',
                     DATE '1960-01-01' + CAST(trunc(sas_day) AS INTEGER)) AS INTEGER) AS back_day
FROM s"""

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _norm_text(x: str) -> str:
    return (f"CASE WHEN rtrim({x}, {_WS}) IN ('', '.') THEN NULL "
            f"ELSE rtrim({x}, {_WS}) END")


ORACLE["normalized_customer"] = f"""
WITH r AS (
  SELECT c_custkey,
         CASE WHEN c_custkey % 13 = 0 THEN '.' WHEN c_custkey % 17 = 0 THEN ''
              WHEN c_custkey % 5 = 0 THEN c_name || '   '
              WHEN c_custkey % 19 = 0 THEN c_name || chr(9) || ' ' || chr(10)
              ELSE c_name END AS c_name,
         c_nationkey,
         CASE WHEN c_custkey % 11 = 0 THEN 'NaN'::DOUBLE ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 7 = 0 THEN ' .' WHEN c_custkey % 23 = 0 THEN '   '
              ELSE c_mktsegment END AS c_mktsegment
  FROM customer)
SELECT c_custkey, {_norm_text('c_name')} AS c_name, c_nationkey,
       CASE WHEN isnan(c_acctbal) THEN NULL ELSE c_acctbal END AS c_acctbal,
       {_norm_text('c_mktsegment')} AS c_mktsegment
FROM r"""


def _line_sql(cols: list[str]) -> str:
    field = lambda c: f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')"
    return "sha256(concat_ws(chr(31), " + ", ".join(map(field, cols)) + "))"


_PIECE_SUMS = " || '|' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 16 * i}, 16) AS UBIGINT)) AS VARCHAR)" for i in range(4))


def _digest_sql(table: str, cols: list[str]) -> str:
    return f"""
SELECT '{table}' AS table_name, n_rows, hash_sum, sha256('{",".join(cols)}' || '|' || CAST(n_rows AS VARCHAR) || '|' || hash_sum) AS digest
FROM (SELECT CAST(count(*) AS BIGINT) AS n_rows, {_PIECE_SUMS} AS hash_sum FROM (SELECT {_line_sql(cols)} AS h FROM {table}))"""


# Every column of each table, in order.
DIGEST_TABLES = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "lineitem": LINE_COLS,
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
}
ORACLE["content_digest"] = "\nUNION ALL\n".join(_digest_sql(t, c) for t, c in DIGEST_TABLES.items())


# ---------------------------------------------------------------- phase 4

ORACLE["first_last"] = """
SELECT event_id, user_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS first_user_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS last_user_id
FROM events"""

ORACLE["first_last_2level"] = """
SELECT event_id,
  row_number() OVER (PARTITION BY event_type ORDER BY user_id, ts, event_id) = 1 AS first_event_type,
  row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC, ts DESC, event_id DESC) = 1
    AS last_event_type,
  row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1 AS first_user_id,
  row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1
    AS last_user_id
FROM events"""

ORACLE["retain_locf"] = """
WITH e AS (SELECT event_id, ts, user_id,
                  CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value_in FROM events)
SELECT event_id, user_id, value_in,
       last_value(value_in IGNORE NULLS) OVER w AS retained,
       round(sum(coalesce(value_in, 0)) OVER w, 6) AS running_total
FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

ORACLE["nodupkey"] = """
SELECT * FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
        l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1"""

ORACLE["proc_means_types"] = """
SELECT c_mktsegment, c_nationkey,
       CAST(3 - grouping(c_mktsegment, c_nationkey) AS INTEGER) AS _TYPE_,
       count(*) AS _FREQ_, count(c_acctbal) AS n_acctbal,
       round(avg(c_acctbal), 6) AS mean_acctbal, round(stddev_samp(c_acctbal), 6) AS std_acctbal,
       min(c_acctbal) AS min_acctbal, max(c_acctbal) AS max_acctbal
FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)"""

ORACLE["proc_means_table"] = """
SELECT l_returnflag,
       count(l_quantity) AS l_quantity_n, round(avg(l_quantity), 6) AS l_quantity_mean,
       round(stddev_samp(l_quantity), 6) AS l_quantity_std,
       min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
       count(l_extendedprice) AS l_extendedprice_n, round(avg(l_extendedprice), 6) AS l_extendedprice_mean,
       round(stddev_samp(l_extendedprice), 6) AS l_extendedprice_std,
       min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max
FROM lineitem GROUP BY l_returnflag"""

ORACLE["freq_oneway"] = """
WITH f AS (SELECT o_custkey, count(*) AS frequency FROM orders
           WHERE o_custkey IS NOT NULL GROUP BY o_custkey),
c AS (SELECT o_custkey, frequency,
             sum(frequency) OVER (ORDER BY o_custkey ROWS UNBOUNDED PRECEDING) AS cum,
             sum(frequency) OVER () AS total
      FROM f)
SELECT o_custkey, frequency,
       round(CAST(frequency AS DOUBLE) * 100.0 / CAST(total AS DOUBLE), 6) AS percent,
       CAST(cum AS BIGINT) AS cum_frequency,
       round(CAST(cum AS DOUBLE) * 100.0 / CAST(total AS DOUBLE), 6) AS cum_percent
FROM c"""

ORACLE["freq_twoway"] = """
WITH f AS (SELECT l_returnflag, l_linestatus, count(*) AS frequency FROM lineitem
           WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL)
SELECT l_returnflag, l_linestatus, frequency,
  round(CAST(frequency AS DOUBLE) * 100.0 / CAST(sum(frequency) OVER () AS DOUBLE), 6) AS percent,
  round(CAST(frequency AS DOUBLE) * 100.0
        / CAST(sum(frequency) OVER (PARTITION BY l_returnflag) AS DOUBLE), 6) AS row_percent,
  round(CAST(frequency AS DOUBLE) * 100.0
        / CAST(sum(frequency) OVER (PARTITION BY l_linestatus) AS DOUBLE), 6) AS col_percent
FROM f"""

ORACLE["transpose_wide"] = "SELECT l_orderkey, 'l_quantity' AS _NAME_, " + ", ".join(
    f"max(l_quantity) FILTER (WHERE l_linenumber = {v}) AS _{v}" for v in range(1, 8)) + \
    " FROM lineitem GROUP BY l_orderkey"

ORACLE["transpose_long"] = """
SELECT o_orderkey, 'o_totalprice' AS _NAME_, CAST(o_totalprice AS DOUBLE) AS COL1 FROM orders
UNION ALL
SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders"""

ORACLE["merge_by"] = """
SELECT CASE WHEN o.orderkey IS NOT NULL THEN o.orderkey ELSE l.orderkey END AS orderkey,
       CASE WHEN l.orderkey IS NOT NULL THEN l.status ELSE o.status END AS status,
       o.o_totalprice, l.l_linenumber, l.l_quantity,
       o.orderkey IS NOT NULL AS in_left, l.orderkey IS NOT NULL AS in_right
FROM (SELECT o_orderkey AS orderkey, o_orderstatus AS status, o_totalprice FROM orders) o
FULL OUTER JOIN (SELECT l_orderkey AS orderkey, l_linestatus AS status, l_linenumber, l_quantity
                 FROM lineitem) l
ON o.orderkey = l.orderkey"""

ORDERS_MISSING = """
orders_m AS (
  SELECT o_orderkey, o_orderstatus,
         CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS price_m,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS prio_m,
         CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderdate END AS date_m,
         CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority || '  ' ELSE o_orderpriority END
           AS prio_padded,
         o_orderpriority, o_totalprice
  FROM orders)"""

ORACLE["sas_sort_rank"] = f"""
WITH {ORDERS_MISSING}
SELECT o_orderkey,
       row_number() OVER (ORDER BY prio_m ASC NULLS FIRST, price_m DESC NULLS LAST, o_orderkey)
         AS sort_position
FROM orders_m"""


def _lt(a: str, b: str) -> str:
    return f"(CASE WHEN {b} IS NULL THEN false WHEN {a} IS NULL THEN true ELSE {a} < {b} END)"


def _le(a: str, b: str) -> str:
    return f"(CASE WHEN {a} IS NULL THEN true WHEN {b} IS NULL THEN false ELSE {a} <= {b} END)"


ORACLE["sas_predicates"] = f"""
WITH {ORDERS_MISSING}
SELECT o_orderstatus,
  count(*) FILTER (WHERE {_lt('price_m', '250000.0')}) AS n_lt,
  count(*) FILTER (WHERE {_le('price_m', '250000.0')}) AS n_le,
  count(*) FILTER (WHERE {_lt('250000.0', 'price_m')}) AS n_gt,
  count(*) FILTER (WHERE {_le('250000.0', 'price_m')}) AS n_ge,
  count(*) FILTER (WHERE price_m IS NOT DISTINCT FROM NULL) AS n_eq_missing,
  count(*) FILTER (WHERE price_m IS DISTINCT FROM NULL) AS n_ne_missing,
  count(*) FILTER (WHERE {_lt('prio_m', "'2'")}) AS n_prio_lt_2,
  count(*) FILTER (WHERE rtrim(coalesce(prio_padded, ''), ' ') = rtrim(coalesce(o_orderpriority, ''), ' '))
    AS n_text_eq,
  count(*) FILTER (WHERE prio_padded = o_orderpriority) AS n_plain_eq,
  count(*) FILTER (WHERE o_orderkey % 6 <> 0) AS n_numeric
FROM orders_m GROUP BY o_orderstatus"""

_ETL_FILTERED = f"""{ORDERS_MISSING},
filtered AS (SELECT * FROM orders_m WHERE {_le("TIMESTAMP '1995-01-01 00:00:00'", 'date_m')})"""

ORACLE["etl_summary"] = f"""
WITH {_ETL_FILTERED}
SELECT o_orderpriority, count(*) AS n FROM filtered GROUP BY o_orderpriority"""

ORACLE["etl_stats"] = f"""
WITH {_ETL_FILTERED}
SELECT 0 AS _TYPE_, count(*) AS _FREQ_, round(avg(price_m), 6) AS avg_totalprice FROM filtered"""


# ---------------------------------------------------------------- phase 5

_STATUS_CASE = ("CASE event_type WHEN 'signup' THEN 'registered' WHEN 'view' THEN 'landed' "
                "WHEN 'click' THEN 'translated' WHEN 'purchase' THEN 'parity_pass' "
                "WHEN 'error' THEN 'triage' END")

STATE = f"""
upd AS (
  SELECT 'p' || CAST(user_id AS VARCHAR) AS key,
         json_object('status', {_STATUS_CASE}, 'event_id', event_id)::VARCHAR AS payload, ts
  FROM events),
state AS (SELECT key, arg_max(payload, ts) AS payload, max(ts) AS updated_at FROM upd GROUP BY key),
status AS (SELECT key, json_extract_string(payload, '$.status') AS status FROM state)"""

ORACLE["latest_state"] = f"""
WITH {STATE}
SELECT key, payload, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM state"""

ORACLE["pending"] = f"""
WITH {STATE}
SELECT key, status FROM status WHERE status IS DISTINCT FROM 'parity_pass'"""

ORACLE["funnel"] = f"""
WITH {STATE}
SELECT status, count(*) AS n FROM status GROUP BY status"""

CALLS = """
calls AS (
  SELECT 'p' || CAST(user_id AS VARCHAR) AS program_id, user_id, event_id, ts, 'm1' AS model,
         event_type AS purpose, CAST(round(value * 100) AS BIGINT) AS input_tokens,
         event_id % 50 AS output_tokens, round(value / 10, 3) AS latency_s,
         CASE WHEN event_type = 'error' THEN
              CASE WHEN event_id % 5 = 0 THEN 'circuit_open' ELSE 'retries_exhausted' END END AS error
  FROM events)"""

ORACLE["usage_summary"] = f"""
WITH {CALLS}
SELECT program_id, count(*) AS calls, count(error) AS errors,
       count(*) FILTER (WHERE error = 'circuit_open') AS refusals,
       CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       round(avg(latency_s), 6) AS avg_latency_s
FROM calls GROUP BY program_id"""

ORACLE["migration_metrics"] = f"""
WITH {STATE}, {CALLS}
SELECT CAST(count(*) AS BIGINT) AS programs,
       round(count(*) FILTER (WHERE status = 'parity_pass') / count(*), 6) AS pass_rate,
       round(count(*) FILTER (WHERE status = 'triage') / count(*), 6) AS triage_rate,
       round((SELECT count(*) FROM calls) / count(*), 6) AS calls_per_program
FROM status"""

TRIPS = f"""
run_used AS (
  SELECT program_id, event_id,
         sum(input_tokens + output_tokens) OVER (PARTITION BY program_id ORDER BY ts, event_id
                                                 ROWS UNBOUNDED PRECEDING) AS used,
         row_number() OVER (PARTITION BY program_id ORDER BY ts, event_id) AS call_no
  FROM calls),
trips AS (
  SELECT program_id, call_no AS trip_call_no, CAST(used AS BIGINT) AS used_at_trip,
         event_id AS trip_event_id
  FROM run_used WHERE used > {I.CALL_CAP}
  QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY call_no) = 1)"""

ORACLE["budget_trips"] = f"WITH {CALLS}, {TRIPS}\nSELECT * FROM trips"

ORACLE["batch_budget"] = f"""
WITH {CALLS},
per AS (SELECT program_id, user_id, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens
        FROM calls GROUP BY program_id, user_id),
c AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY user_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
                  AS cum_tokens FROM per)
SELECT program_id, tokens, cum_tokens,
       CASE WHEN cum_tokens - tokens <= {I.BATCH_CAP} THEN 'processed' ELSE 'pending' END
         AS batch_status
FROM c"""

ORACLE["failure_runs"] = f"""
WITH {CALLS},
s AS (SELECT *, sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END)
                  OVER (PARTITION BY program_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
                  AS island
      FROM calls)
SELECT program_id, CAST(island AS BIGINT) AS successes_before, CAST(count(*) AS BIGINT) AS failures,
       arg_min(event_id, ts) AS first_event_id, arg_max(event_id, ts) AS last_event_id
FROM s WHERE error IS NOT NULL AND error <> 'circuit_open'
GROUP BY program_id, island HAVING count(*) >= {I.BREAKER_THRESHOLD}"""

OUTCOMES = """
att AS (
  SELECT 'p' || CAST(user_id AS VARCHAR) AS program_id, event_id, ts,
         CASE WHEN event_type IN ('purchase', 'error') THEN 'match' ELSE 'run' END AS loop,
         CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE event_id % 3 END AS step_index,
         event_id % 5 + 1 AS outer_attempt, event_type <> 'error' AS ok
  FROM events),
per AS (SELECT program_id, arg_max(loop, ts) AS last_loop, arg_max(ok, ts) AS last_ok,
               CAST(max(outer_attempt) AS BIGINT) AS outer_attempts FROM att GROUP BY program_id),
rr AS (SELECT program_id, CAST(sum(n - 1) AS BIGINT) AS run_repairs
       FROM (SELECT program_id, outer_attempt, step_index, count(*) AS n FROM att
             WHERE loop = 'run' GROUP BY ALL) GROUP BY program_id),
m AS (
  SELECT per.program_id, outer_attempts, coalesce(run_repairs, 0) AS run_repairs,
         CASE WHEN t.program_id IS NOT NULL THEN 'budget'
              WHEN last_loop = 'match' AND last_ok THEN NULL
              WHEN last_loop = 'run' AND NOT last_ok THEN 'never_ran'
              WHEN last_loop = 'match' THEN 'diverged' ELSE 'never_ran' END AS failure_mode
  FROM per LEFT JOIN rr USING (program_id) LEFT JOIN trips t USING (program_id)),
outcomes AS (
  SELECT program_id, CASE WHEN failure_mode IS NULL THEN 'parity_pass' ELSE 'triage' END AS status,
         failure_mode, outer_attempts, CAST(run_repairs AS BIGINT) AS run_repairs
  FROM m)"""

ORACLE["outcomes"] = f"WITH {CALLS}, {TRIPS}, {OUTCOMES}\nSELECT * FROM outcomes"

def _group_vals(group: str) -> list[tuple[str, bool]]:
    return [(c, f) for c, f in ORDER_VALS if c != group]


def grouped_sql(group: str) -> str:
    """Keyed stats of orders per group. The group is part of the key: an order
    that moved to another group is missing here and extra there."""
    vals = _group_vals(group)
    cells = " + ".join(f"count(*) FILTER (WHERE {_MATCHED} AND NOT {_orders_match(c, f)})" for c, f in vals)
    pairs = ", ".join(f"g.{c} AS g_{c}, b.{c} AS b_{c}" for c, _ in vals)
    return f"""grouped_j AS (SELECT coalesce(g.{group}, b.{group}) AS program_id,
  g.o_orderkey AS gk, b.o_orderkey AS bk, {pairs}
  FROM orders g FULL OUTER JOIN orders_bad b
    ON g.o_orderkey IS NOT DISTINCT FROM b.o_orderkey AND g.{group} IS NOT DISTINCT FROM b.{group}),
grouped AS (
  SELECT program_id,
         CAST(count(*) FILTER (WHERE gk IS NOT NULL) AS BIGINT) AS gt_rows,
         CAST(count(*) FILTER (WHERE bk IS NOT NULL) AS BIGINT) AS out_rows,
         CAST(count(*) FILTER (WHERE gk IS NOT NULL AND bk IS NULL) AS BIGINT) AS missing_rows,
         CAST(count(*) FILTER (WHERE bk IS NOT NULL AND gk IS NULL) AS BIGINT) AS extra_rows,
         CAST({cells} AS BIGINT) AS mismatched_cells
  FROM grouped_j GROUP BY program_id)"""


GROUPED = grouped_sql("o_orderpriority")

ORACLE["grouped_parity"] = f"""
WITH {ORDERS_BAD}, {GROUPED}
SELECT *, (gt_rows = out_rows AND missing_rows = 0 AND extra_rows = 0 AND mismatched_cells = 0)
          AS passed
FROM grouped"""

def diff_sql(group: str) -> str:
    """CTEs up to ``diffs``: the diff text of each group."""
    vals = _group_vals(group)
    cols = "\nUNION ALL\n".join(f"""SELECT program_id, '{c}' AS column_name,
       count(*) FILTER (WHERE {_MATCHED} AND NOT {_orders_match(c, f)}) AS mismatches,
       count(*) FILTER (WHERE {_MATCHED}) AS total
FROM grouped_j GROUP BY program_id""" for c, f in vals)
    bad = "\nUNION ALL\n".join(f"""SELECT program_id, '{c}' AS column_name, gk AS o_orderkey,
       CAST(g_{c} AS VARCHAR) AS gt_value, CAST(b_{c} AS VARCHAR) AS out_value
FROM grouped_j WHERE {_MATCHED} AND NOT {_orders_match(c, f)}""" for c, f in vals)
    return f"""{grouped_sql(group)},
gcols AS ({cols}),
gbad AS ({bad}),
gsamp AS (
  SELECT *, row_number() OVER (PARTITION BY program_id, column_name ORDER BY o_orderkey) AS sample_no
  FROM gbad),
lines AS (
  SELECT program_id, 0 AS c, '' AS n, 0 AS s,
         printf('[%s] table orders: ground_truth=%d rows, output=%d rows, missing=%d, extra=%d',
                CASE WHEN gt_rows = out_rows AND missing_rows = 0 AND extra_rows = 0
                          AND mismatched_cells = 0 THEN 'PASS' ELSE 'FAIL' END,
                gt_rows, out_rows, missing_rows, extra_rows) AS line
  FROM grouped
  UNION ALL
  SELECT program_id, 2, column_name, 0,
         printf('  column %s: %d/%d mismatched (%.2f%%)', column_name, mismatches, total,
                CAST(mismatches AS DOUBLE) * 100.0 / CAST(total AS DOUBLE))
  FROM gcols WHERE mismatches > 0
  UNION ALL
  SELECT program_id, 2, column_name, sample_no,
         '    sample: o_orderkey=' || CAST(o_orderkey AS VARCHAR) || ': ' || column_name || ' '
         || coalesce(gt_value, 'None') || ' != ' || coalesce(out_value, 'None')
  FROM gsamp WHERE sample_no <= 5),
diffs AS (SELECT program_id, string_agg(line, chr(10) ORDER BY c, n, s) AS text FROM lines GROUP BY program_id)"""


ORACLE["diff_text"] = f"WITH {ORDERS_BAD}, {diff_sql('o_orderpriority')}\nSELECT program_id, text FROM diffs"


# ---------------------------------------------------------------- phase 6

_K = "c_custkey"
_KS = "CAST(c_custkey AS VARCHAR)"
_NL = "chr(10)"

PROGRAMS = f"""
programs AS (
  SELECT 'c' || {_KS} AS program_id, '/corpus/progs/c' || {_KS} || '.sas' AS path,
  concat_ws({_NL},
    '/* program for ' || c_name || ' */',
    CASE WHEN d.text IS NOT NULL THEN '/* notes:' || {_NL} || d.text || {_NL} || '*/' END,
    'options nodate;',
    'libname mylib ''/data/mylib'';',
    '%let seg = ' || c_mktsegment || ';',
    '%let cutoff = 199' || CAST({_K} % 10 AS VARCHAR) || '-01-01;',
    CASE WHEN {_K} % 2 = 0 THEN '%include ''macros/' || lower(c_mktsegment) || '.sas'';' END,
    CASE WHEN {_K} % 10 = 0 THEN '%include ''missing/nothing.sas'';' END,
    'data work.c' || {_KS} || ';',
    '  set mylib.orders;',
    '  where o_custkey = ' || {_KS} || ' and o_orderdate >= "&cutoff."d and seg = "&seg" and code = "&segment_code";',
    'run;',
    CASE WHEN {_K} % 4 = 0 THEN '%let cutoff = 2000-01-01;' END,
    'proc sql;',
    '  create table work.s' || {_KS} || ' as',
    '  select o_orderpriority, count(*) as n',
    '  from work.c' || {_KS} || ' /* inline */',
    '  group by o_orderpriority;',
    'quit;',
    CASE WHEN {_K} % 4 <> 0 THEN 'proc means data=work.c' || {_KS} || ' noprint;' || {_NL}
         || '  var o_totalprice;' || {_NL} || '  output out=work.m' || {_KS} || ' mean=avg_price;'
         || {_NL} || 'run;' END,
    CASE WHEN {_K} % 5 = 0 THEN 'data work.flag' || {_KS} || '; set work.c' || {_KS} || ';' || {_NL}
         || 'proc print data=work.flag' || {_KS} || '; run;' END,
    CASE WHEN {_K} % 7 = 0 THEN '%macro report' || {_KS} || '(tbl);' || {_NL}
         || '  proc print data=&tbl; run;' || {_NL} || '  data x; set y; run;' || {_NL} || '%mend;'
         || {_NL} || '%report' || {_KS} || '(work.s' || {_KS} || ');' END
  ) AS source
  FROM (SELECT coalesce(c_custkey, doc_id) AS c_custkey, coalesce(c_name, 'none') AS c_name,
          coalesce(c_mktsegment, 'BUILDING') AS c_mktsegment, text
        FROM customer FULL JOIN documents ON c_custkey = doc_id) d)"""

# Patterns of the generated scripts, which the generator above knows.
_COMMENT = r"/\*(?:[^*]|\*+[^*/])*\*+/"

ORACLE["stripped_comments"] = f"""
WITH {PROGRAMS},
s AS (SELECT program_id, string_split_regex(source, '{_COMMENT}') AS pieces,
             regexp_extract_all(source, '{_COMMENT}') AS comments FROM programs)
SELECT program_id,
       pieces[1] || array_to_string(list_transform(generate_series(1, len(comments)),
         lambda i: repeat(chr(10), length(comments[i]) - length(replace(comments[i], chr(10), '')))
                   || pieces[i + 1]), '') AS source
FROM s"""

_LET = r"(?m)^%let ([a-z_]+) = ([^;\n]*);[ \t]*$"
_PYWS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE["expanded_lets"] = f"""
WITH {PROGRAMS},
s AS (SELECT program_id, source, regexp_extract_all(source, '{_LET}', 1) AS names,
             regexp_extract_all(source, '{_LET}', 2) AS vals FROM programs),
d AS (SELECT program_id, source,
        list_sort(list_filter(list_transform(generate_series(1, len(names)), lambda i: {{
            'neg_len': -length(names[i]), 'i': i, 'name': names[i],
            'value': vals[len(names) - list_position(list_reverse(names), names[i]) + 1]}}),
          lambda x: NOT list_contains(names[1:x.i - 1], x.name))) AS defs
      FROM s)
SELECT program_id,
       list_reduce(defs, lambda acc, x: regexp_replace(acc, '(?i)&' || x.name || '\\.?',
                   replace(trim(x.value, {_PYWS}), '\\', '\\\\'), 'g'),
                   regexp_replace(source, '{_LET}', '', 'g')) AS source
FROM d"""

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# What each kind of generated step does, by its number: no pattern is needed.
ORACLE["write_targets"] = """
WITH steps AS (
  SELECT coalesce(o_orderkey, doc_id) AS k FROM orders FULL JOIN documents ON o_orderkey = doc_id),
x AS (SELECT k, 's' || k AS step_id, CASE WHEN k % 23 <> 0 THEN 'sandbox_p' || (k % 7) END AS sandbox,
             'sandbox_p' || CASE WHEN k % 23 <> 0 THEN k % 7 ELSE 0 END AS own FROM steps),
hits AS (
  SELECT step_id, sandbox, 'write' AS kind, unnest(CASE k % 8
      WHEN 0 THEN [own || '.t' || k] WHEN 1 THEN ['ground_truth.t' || k] WHEN 2 THEN ['staging_inputs.x' || k]
      WHEN 3 THEN [own || '.t' || k] WHEN 4 THEN ['ground_truth.t' || k] WHEN 5 THEN ['données.über' || k]
      WHEN 6 THEN ['z.t' || k, 'a.t' || k] ELSE [] END) AS detail FROM x
  UNION ALL SELECT step_id, NULL, 'context', 'USE s' FROM x WHERE k % 8 = 7
  UNION ALL SELECT step_id, NULL, 'context', '.setCurrentDatabase(' FROM x WHERE k % 5 = 0)
SELECT step_id, kind, detail FROM hits WHERE kind = 'context' OR sandbox IS NULL OR NOT starts_with(detail, sandbox || '.')"""

ORACLE["sandbox_verdicts"] = """
WITH steps AS (
  SELECT coalesce(o_orderkey, doc_id) AS k FROM orders FULL JOIN documents ON o_orderkey = doc_id),
v AS (
  SELECT 's' || k AS step_id, CASE WHEN k % 8 = 7 THEN 'context: USE s' WHEN k % 5 = 0 THEN 'context: .setCurrentDatabase('
    WHEN k % 8 IN (0, 3) THEN CASE WHEN k % 23 = 0 THEN 'write: sandbox_p0.t' || k END
    WHEN k % 8 IN (1, 4) THEN 'write: ground_truth.t' || k WHEN k % 8 = 2 THEN 'write: staging_inputs.x' || k
    WHEN k % 8 = 5 THEN 'write: données.über' || k WHEN k % 8 = 6 THEN 'write: z.t' || k END AS violation
  FROM steps)
SELECT step_id, violation IS NULL AS allowed, violation FROM v"""

ORACLE["sql_statements"] = f"""
WITH s AS (
  SELECT coalesce(o_orderkey, doc_id) AS k, coalesce(o_orderpriority, 'none') AS p, text
  FROM orders FULL JOIN documents ON o_orderkey = doc_id),
l AS (
  SELECT 'q' || k AS script_id, list_filter(
    CASE WHEN text IS NULL THEN [] ELSE ['SELECT ''' || replace(text, '''', '''''') || ''' AS d',
      trim(regexp_replace(text, '['';]', '~', 'g'), {_PYWS})] END
    || ['SELECT ''' || p || ';' || k || ''' AS p']
    || CASE k % 3 WHEN 0 THEN ['INSERT INTO t VALUES (''O''''Brien; ' || k || ''')'] WHEN 1 THEN ['SELECT 2']
         ELSE ['SELECT ''open; ' || k] END, lambda x: x <> '') AS l
  FROM s)
SELECT script_id, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS stmt_no, unnest(l) AS statement FROM l"""

ORACLE["parsed_responses"] = f"""
WITH talk AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS talk FROM conversations GROUP BY conv_id),
r0 AS (
  SELECT k, replace(coalesce(doc, ''), '```', '~~~') AS doc, replace(coalesce(talk, ''), '```', '~~~') AS talk,
    CASE WHEN k % 7 = 0 THEN 'python' WHEN k % 2 = 1 THEN 'pyspark' ELSE 'sql' END AS lang
  FROM (SELECT coalesce(o.k, conv_id) AS k, doc, talk
        FROM (SELECT coalesce(o_orderkey, doc_id) AS k, text AS doc FROM orders FULL JOIN documents ON o_orderkey = doc_id) o
        FULL JOIN talk ON o.k = conv_id)),
r AS (
  SELECT 'r' || CAST(k AS VARCHAR) AS response_id, CAST(k % 9 AS INTEGER) AS step_index,
         'Here is the step.' || chr(10) ||
         CASE WHEN k % 3 = 0 THEN '```text' || chr(10) || talk || chr(10) || '```' || chr(10) ELSE talk || chr(10) END ||
         CASE WHEN k % 11 = 0 THEN ''
              WHEN k % 13 = 0 THEN '```json' || chr(10) || '{{language: sql' || chr(10) || '```' || chr(10)
              ELSE '```json' || chr(10) || '{{"language": "' || lang || '", "inputs": ["in' || CAST(k AS VARCHAR)
                   || '"], "outputs": ["out' || CAST(k AS VARCHAR) || '"]}}' || chr(10) || '```' || chr(10) END ||
         CASE WHEN k % 5 = 0 THEN 'then' || chr(10) || '```text' || chr(10) || 'no code' || chr(10) || '```' || chr(10) ELSE '' END ||
         CASE WHEN k % 17 = 0 THEN 'no code here'
              ELSE '```' || CASE WHEN lang = 'sql' THEN 'sql' ELSE 'python' END || chr(10)
                   || '  /* ' || doc || ' */ SELECT * FROM in' || CAST(k AS VARCHAR) || ';  ' || chr(10) || '```' END AS text
  FROM r0),
x AS (
  SELECT response_id, step_index, text,
         regexp_matches(text, '(?s)```json\\s*\\n.*?```') AS has_header,
         regexp_extract(text, '(?s)```json\\s*\\n(.*?)```(.*)', 1) AS header,
         regexp_extract(text, '(?s)```json\\s*\\n(.*?)```(.*)', 2) AS rest
  FROM r),
y AS (
  SELECT *, coalesce(json_valid(header) AND starts_with(trim(header), '{{'), false) AS valid,
         regexp_matches(rest, '(?s)```(sql|python|pyspark)\\s*\\n(.*?)```') AS has_code
  FROM x),
z AS (
  SELECT *, CASE WHEN valid THEN coalesce(json_extract_string(header, '$.language'), '') ELSE '' END AS lang,
         CASE WHEN NOT has_header THEN 'missing ```json header block'
              WHEN NOT valid THEN 'bad json header'
              WHEN NOT has_code THEN 'missing code block after header'
              WHEN coalesce(json_extract_string(header, '$.language'), '') NOT IN ('sql', 'pyspark')
                THEN 'language must be sql|pyspark, got ''' ||
                     coalesce(json_extract_string(header, '$.language'), '') || ''''
         END AS error
  FROM y)
SELECT response_id, step_index,
       CASE WHEN error IS NULL THEN lang END AS language,
       CASE WHEN error IS NULL THEN trim(regexp_extract(rest, '(?s)```(sql|python|pyspark)\\s*\\n(.*?)```', 2),
                                        {_PYWS}) END AS code,
       CASE WHEN error IS NULL THEN array_to_string(CAST(json_extract(header, '$.inputs') AS VARCHAR[]), ',') END
         AS inputs,
       CASE WHEN error IS NULL THEN array_to_string(CAST(json_extract(header, '$.outputs') AS VARCHAR[]), ',') END
         AS outputs,
       error
FROM z"""

# Every code point Python's str.isspace() accepts (what str.strip() removes).
_WS_ALL = " || ".join(f"chr({c})" for c in (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197,
    8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288))

_INC = "%include '([^'\"\n]+)';"

FILES = """
files AS (
  SELECT DISTINCT '/corpus/progs/macros/' || lower(c_mktsegment) || '.sas' AS fpath,
         '%macro dedupe_' || lower(c_mktsegment) || '(tbl);' || chr(10)
         || '  proc sort data=&tbl nodupkey; by id; run;' || chr(10) || '%mend;' || chr(10)
         || '%include ''common/util.sas'';' || chr(10) AS ftext
  FROM customer
  UNION ALL
  SELECT '/corpus/progs/macros/common/util.sas',
         '/* shared utilities */' || chr(10) || '%let util_version = ' || CAST(count(*) AS VARCHAR)
         || ';' || chr(10)
  FROM region)"""


def _abs_sql(text: str, folder: str) -> str:
    return (f"CASE WHEN coalesce({folder}, '') = '' THEN {text} ELSE "
            f"regexp_replace({text}, '(?i)(%include\\s+[''\"])([^/''\"])', "
            f"'\\1' || {folder} || '/\\2', 'g') END")


def _dir_sql(p: str) -> str:
    return f"regexp_extract({p}, '^(.*)/[^/]*$', 1)"


def _include_round(src: str, dst: str) -> str:
    """One nesting level: inline every include of texts that have one."""
    return f"""
{dst}_t AS (
  SELECT program_id, i AS pos, targets[i] AS target
  FROM (SELECT program_id, regexp_extract_all(source, {_q(_INC)}, 1) AS targets
        FROM {src} WHERE err IS NULL AND regexp_matches(source, {_q(_INC)})),
       LATERAL (SELECT unnest(generate_series(1, len(targets))) AS i)),
{dst}_g AS (
  SELECT t.program_id, list(CASE WHEN f.fpath IS NULL THEN NULL
                                 ELSE {_abs_sql('f.ftext', _dir_sql('f.fpath'))} END ORDER BY t.pos) AS fills,
         min(CASE WHEN f.fpath IS NULL THEN t.target END) AS missing
  FROM {dst}_t t LEFT JOIN files f ON t.target = f.fpath GROUP BY t.program_id),
{dst} AS (
  SELECT s.program_id,
         CASE WHEN g.program_id IS NULL OR g.missing IS NOT NULL THEN s.source
              ELSE string_split_regex(s.source, {_q(_INC)})[1]
                   || array_to_string(list_transform(generate_series(1, len(g.fills)),
                        lambda i: g.fills[i] || string_split_regex(s.source, {_q(_INC)})[i + 1]), '')
         END AS source,
         coalesce(s.err, CASE WHEN g.missing IS NOT NULL THEN 'include not found: ' || g.missing END) AS err
  FROM {src} s LEFT JOIN {dst}_g g USING (program_id))"""


RESOLVED = f"""{PROGRAMS}, {FILES},
inc0 AS (SELECT program_id, {_abs_sql('source', _dir_sql('path'))} AS source,
                CAST(NULL AS VARCHAR) AS err FROM programs),
{_include_round('inc0', 'inc1')},
{_include_round('inc1', 'inc2')},
{_include_round('inc2', 'inc3')},
resolved AS (
  SELECT program_id, source,
         coalesce(err, CASE WHEN regexp_matches(source, {_q(_INC)})
                            THEN '%include nesting exceeds max depth' END) AS include_error
  FROM inc3)"""

ORACLE["resolved_includes"] = f"WITH {RESOLVED}\nSELECT program_id, source, include_error FROM resolved"


def _lets_sql(src: str, dst: str) -> str:
    return f"""
{dst}_s AS (SELECT program_id, source, regexp_extract_all(source, '{_LET}', 1) AS names,
                   regexp_extract_all(source, '{_LET}', 2) AS vals FROM {src}),
{dst}_d AS (SELECT program_id, source,
        list_sort(list_filter(list_transform(generate_series(1, len(names)), lambda i: {{
            'neg_len': -length(names[i]), 'i': i, 'name': names[i],
            'value': vals[len(names) - list_position(list_reverse(names), names[i]) + 1]}}),
          lambda x: NOT list_contains(names[1:x.i - 1], x.name))) AS defs
      FROM {dst}_s),
{dst} AS (SELECT program_id,
       list_reduce(defs, lambda acc, x: regexp_replace(acc, '(?i)&' || x.name || '\\.?',
                   replace(trim(x.value, {_WS_ALL}), '\\', '\\\\'), 'g'),
                   regexp_replace(source, '{_LET}', '', 'g')) AS source
      FROM {dst}_d)"""


_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

STEPS_CTES = f"""{RESOLVED},
{_lets_sql('resolved', 'expanded')},
stripped AS (
  SELECT program_id,
         string_split_regex(source, '{_COMMENT}')[1]
         || array_to_string(list_transform(generate_series(1, len(regexp_extract_all(source, '{_COMMENT}'))),
              lambda i: repeat(chr(10), length(regexp_extract_all(source, '{_COMMENT}')[i])
                                        - length(replace(regexp_extract_all(source, '{_COMMENT}')[i], chr(10), '')))
                        || string_split_regex(source, '{_COMMENT}')[i + 1]), '') AS source
  FROM expanded),
lines0 AS (SELECT program_id, string_split_regex(source, {_q(_LINE_BREAK)}) AS l FROM stripped),
lines AS (SELECT program_id, unnest(generate_series(0, len(l) - 1)) AS line_no, unnest(l) AS line
          FROM lines0),
f AS (
  SELECT program_id, line_no, line,
         lower(regexp_extract(line, '(?i)^\\s*(data\\b|proc\\s+\\w+|%macro\\b)', 1)) AS tok0,
         regexp_matches(line, '(?i)^\\s*data\\s*=') AS data_eq,
         regexp_matches(line, '(?i)^\\s*%mend\\b.*;') AS mend,
         regexp_matches(line, '(?i)^\\s*(run|quit)\\s*;') AS rq
  FROM lines),
f2 AS (
  SELECT *, tok0 <> '' AND NOT (tok0 = 'data' AND data_eq) AS is_start,
         CASE WHEN starts_with(tok0, '%macro') THEN 'macro' WHEN starts_with(tok0, 'data') THEN 'data'
              ELSE 'proc' END AS tok
  FROM f),
w1 AS (
  SELECT *,
    max(CASE WHEN is_start AND tok = 'macro' THEN line_no END) OVER prev AS mac_prev,
    max(CASE WHEN mend THEN line_no END) OVER prev AS mend_prev,
    max(CASE WHEN rq THEN line_no END) OVER prev AS rq_prev
  FROM f2
  WINDOW prev AS (PARTITION BY program_id ORDER BY line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w2 AS (
  SELECT *, is_start AND NOT (mac_prev IS NOT NULL AND (mend_prev IS NULL OR mend_prev < mac_prev)) AS eff
  FROM w1),
w3 AS (
  SELECT *,
    max(CASE WHEN eff THEN line_no END) OVER upto AS s,
    last_value(CASE WHEN eff THEN tok END IGNORE NULLS) OVER upto AS sk
  FROM w2
  WINDOW upto AS (PARTITION BY program_id ORDER BY line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
w4 AS (
  SELECT *,
    CASE WHEN s IS NULL THEN 'global'
         WHEN coalesce(CASE WHEN sk = 'macro' THEN mend_prev >= s ELSE rq_prev >= s END, false) THEN 'global'
         ELSE sk END AS kind
  FROM w3),
w5 AS (SELECT *, (kind = 'macro' AND mend) OR (kind IN ('data', 'proc') AND rq) AS ends FROM w4),
w5b AS (
  SELECT *, eff OR coalesce(lag(ends) OVER (PARTITION BY program_id ORDER BY line_no), false) AS boundary
  FROM w5),
w6 AS (
  SELECT *, sum(CAST(boundary AS INTEGER))
              OVER (PARTITION BY program_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS step
  FROM w5b),
steps AS (
  SELECT program_id, step, arg_min(kind, line_no) AS kind,
         trim(string_agg(line, chr(10) ORDER BY line_no), {_WS_ALL}) AS code
  FROM w6 GROUP BY program_id, step),
stepped AS (
  SELECT program_id, CAST(row_number() OVER (PARTITION BY program_id ORDER BY step) - 1 AS INTEGER)
           AS step_index, kind, code
  FROM steps WHERE code <> '')"""

ORACLE["script_steps"] = f"WITH {STEPS_CTES}\nSELECT program_id, step_index, kind, code FROM stepped"


# ---------------------------------------------------------------- R1 / R3 text

ORACLE["certificates"] = f"""
WITH cj AS (
  SELECT coalesce(a.c_mktsegment, b.c_mktsegment) AS program_id,
         count(a.c_custkey) AS gt_rows, count(b.c_custkey) AS out_rows,
         count(*) FILTER (WHERE b.c_custkey IS NULL) AS missing_rows,
         count(*) FILTER (WHERE a.c_custkey IS NULL) AS extra_rows,
         {_CUST_CELLS} AS cells
  FROM customer a FULL OUTER JOIN customer b ON a.c_custkey IS NOT DISTINCT FROM b.c_custkey
  GROUP BY 1),
progs AS (SELECT c_mktsegment AS program_id, count(*) AS n, count(DISTINCT c_nationkey) AS nations
          FROM customer GROUP BY 1),
dg AS (
  SELECT c_mktsegment AS program_id, CAST(count(*) AS VARCHAR) AS n_rows, {_PIECE_SUMS} AS hash_sum
  FROM (SELECT c_mktsegment, {_line_sql(["c_custkey", "c_name", "c_nationkey", "c_acctbal"])} AS h FROM customer) GROUP BY 1),
snaps AS (SELECT program_id, sha256('c_custkey,c_name,c_nationkey,c_acctbal|' || n_rows || '|' || hash_sum) AS digest FROM dg)
SELECT p.program_id, concat_ws(chr(10),
  '# Parity certificate: ' || p.program_id, '',
  '- program: `/corpus/progs/seg_' || lower(p.program_id) || '.sas` (owner team_' || lower(p.program_id) || ')',
  '- certified at: 2026-01-01T00:00:00',
  '- outer attempts: ' || CAST(p.n % 3 + 1 AS VARCHAR) || ' (run repairs: ' || CAST(p.nations % 4 AS VARCHAR) || ')',
  '- float relative tolerance: ' || printf('%.1e', 1e-9),
  '  (keyless comparisons round floats to 10 significant digits before hashing)', '',
  '| output table | ground-truth rows | output rows | result | method |', '|---|---|---|---|---|',
  '| sandbox_' || lower(p.program_id) || '.customer | ' || CAST(cj.gt_rows AS VARCHAR) || ' | '
    || CAST(cj.out_rows AS VARCHAR) || ' | '
    || CASE WHEN cj.gt_rows = cj.out_rows AND cj.missing_rows = 0 AND cj.extra_rows = 0 AND cj.cells = 0
            THEN 'PASS' ELSE 'FAIL' END || ' | keyed rel_tol=1e-09 |', '',
  '## Input snapshots', '- `staging.customer`: `' || s.digest || '`') AS certificate
FROM progs p JOIN cj USING (program_id) JOIN snaps s USING (program_id)"""

ORACLE["triage_reports"] = f"""
WITH {CALLS}, {TRIPS}, {OUTCOMES}, {ORDERS_BAD}, {diff_sql('o_custkey')},
failing AS (SELECT * FROM outcomes WHERE status = 'triage'),
errors AS (SELECT program_id, arg_max('call ' || CAST(event_id AS VARCHAR) || ': ' || error, ts) AS ev
             FROM calls WHERE error IS NOT NULL GROUP BY program_id),
evidence AS (
  SELECT f.program_id, CASE WHEN f.failure_mode = 'diverged' AND d.text IS NOT NULL THEN
    CASE WHEN length(d.text) > 6000 THEN d.text[:6000] || chr(10) || '...(truncated)' ELSE d.text END ELSE e.ev END AS ev
  FROM failing f LEFT JOIN errors e USING (program_id) LEFT JOIN diffs d ON f.program_id = 'p' || CAST(d.program_id AS VARCHAR)),
steps AS (SELECT program_id, step_index, arg_max(event_id, ts) AS e FROM att WHERE loop = 'run'
          GROUP BY program_id, step_index),
code AS (SELECT program_id, string_agg('### Step ' || CAST(step_index AS VARCHAR) || ' (sql)' || chr(10) || '```sql'
                  || chr(10) || 'SELECT * FROM attempt_' || CAST(e AS VARCHAR) || chr(10) || '```', chr(10)
                  ORDER BY step_index) AS code
         FROM steps GROUP BY program_id)
SELECT f.program_id, concat_ws(chr(10),
  '# Triage report: ' || f.program_id, '',
  '- program: `/corpus/progs/' || f.program_id || '.sas` (owner migration)',
  '- failure mode: ' || coalesce(f.failure_mode, 'unknown'),
  '- outer attempts: ' || CAST(f.outer_attempts AS VARCHAR) || ' (run repairs: ' || CAST(f.run_repairs AS VARCHAR) || ')',
  '- filed at: 2026-01-01T00:00:00', '', '## Evidence', '```', coalesce(e.ev, '(no error text)'), '```', '',
  '## Closest attempt', coalesce(c.code, '(no steps were translated)')) AS report
FROM failing f LEFT JOIN evidence e USING (program_id) LEFT JOIN code c USING (program_id)"""


# ---------------------------------------------------------------- R5 / K4

_STEP_OUT = r"(?i)\b(?:data|create\s+table|out\s*=)\s*([\w.]+)"

ORACLE["implicated_steps"] = f"""
WITH {STEPS_CTES}
, outs AS (SELECT program_id, step_index, unnest(regexp_extract_all(code, {_q(_STEP_OUT)}, 1)) AS out
           FROM stepped),
failed AS (
  SELECT DISTINCT program_id, lower(t) AS t FROM (
    SELECT 'c' || CAST(c_custkey AS VARCHAR) AS program_id,
           unnest([CASE WHEN c_acctbal < 0 THEN 'WORK.S' || CAST(c_custkey AS VARCHAR) END,
                   CASE WHEN c_custkey % 9 = 0 THEN 'work.missing_' || CAST(c_custkey AS VARCHAR) END]) AS t
    FROM customer) WHERE t IS NOT NULL),
hits AS (SELECT DISTINCT o.program_id, o.step_index FROM outs o JOIN failed f
         ON o.program_id = f.program_id AND lower(o.out) = f.t),
fallback AS (
  SELECT s.program_id, max(s.step_index) AS step_index FROM stepped s
  WHERE s.program_id IN (SELECT program_id FROM failed)
    AND s.program_id NOT IN (SELECT program_id FROM hits)
  GROUP BY s.program_id)
SELECT * FROM hits UNION ALL SELECT * FROM fallback"""

ORACLE["call_log_records"] = f"""
WITH {CALLS}
SELECT json_object('program_id', program_id, 'event_id', event_id, 'purpose', purpose,
                   'input_tokens', input_tokens, 'output_tokens', output_tokens, 'error', error)::VARCHAR
         AS payload,
       strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts
FROM calls"""


# ---------------------------------------------------------------- drivers, sources and state

ORACLE["parity_results"] = f"""
WITH {ORDERS_BAD}, {LINEITEM_BAD}, {ORDERS_JOIN}, {ORDERS_SUMMARY}
SELECT 'p_tpch' AS program_id, 'orders' AS table_name, gt_rows, out_rows, missing_rows, extra_rows,
  'keyed rel_tol=1e-09' AS method, CAST(NULL AS VARCHAR) AS error, false AS passed FROM orders_summary
UNION ALL
SELECT 'p_tpch', 'lineitem', *, 'keyless-hash(%.9e) [duplicate-key fallback; rel_tol not applied]', NULL, false
FROM {keyless_sql('lineitem', 'lineitem_bad', LINE_COLS)}
UNION ALL
SELECT 'p_tpch', 'customer', 0, 0, 0, 0, 'error', 'schema mismatch: ground-truth-only columns [''c_acctbal''], output-only columns []', false
UNION ALL
SELECT 'p_tpch', 'nation', 0, 0, 0, 0, 'error', 'type mismatch: n_name (string vs int)', false
UNION ALL
SELECT 'p_tpch', 'supplier', count(*), count(*), 0, 0, 'keyless-hash(%.9e)', NULL, true FROM supplier"""

_LINE_SAME = " AND ".join(f"gc.{c} IS NOT DISTINCT FROM oc.{c}" for c in LINE_COLS)
ORACLE["inventory_parity"] = f"""
WITH {ORDERS_BAD}, {LINEITEM_BAD}, {ORDERS_JOIN},
per_order AS (
  SELECT coalesce(g_o_custkey, b_o_custkey) % 20 AS p, count(gk) AS gt_rows, count(bk) AS out_rows,
    count(*) FILTER (WHERE bk IS NULL) AS missing_rows, count(*) FILTER (WHERE gk IS NULL) AS extra_rows,
    {", ".join(f"count(*) FILTER (WHERE {_MATCHED} AND NOT {_orders_match(c, f)}) AS m_{c}" for c, f in ORDER_VALS)}
  FROM orders_j GROUP BY 1),
orders_in AS (
  SELECT *, CAST({" + ".join(f"m_{c}" for c, _ in ORDER_VALS)} AS BIGINT) AS cells,
    CAST({" + ".join(f"least(m_{c}, 5)" for c, _ in ORDER_VALS)} AS BIGINT) AS samples FROM per_order),
gc AS (SELECT {_LINE_ALL}, count(*) AS n FROM lineitem GROUP BY ALL),
oc AS (SELECT {_LINE_ALL}, count(*) AS n FROM lineitem_bad GROUP BY ALL),
lines AS (
  SELECT coalesce(gc.l_orderkey, oc.l_orderkey) % 20 AS p, coalesce(gc.n, 0) AS gn, coalesce(oc.n, 0) AS onn
  FROM gc FULL OUTER JOIN oc ON {_LINE_SAME}),
per_line AS (
  SELECT p, CAST(sum(gn) AS BIGINT) AS gt_rows, CAST(sum(onn) AS BIGINT) AS out_rows,
    CAST(sum(greatest(gn - onn, 0)) AS BIGINT) AS missing_rows, CAST(sum(greatest(onn - gn, 0)) AS BIGINT) AS extra_rows FROM lines GROUP BY p),
cust AS (SELECT p, (SELECT count(*) FROM customer WHERE p < 9 AND c_custkey % 10 = p) AS n FROM range(10) t(p))
SELECT 'o' || p AS program_id, 'sandbox_o' || p || '.out' AS table_name, gt_rows, out_rows, missing_rows, extra_rows, 'keyed rel_tol=1e-09' AS method,
  gt_rows = out_rows AND missing_rows = 0 AND extra_rows = 0 AND cells = 0 AS passed, cells AS mismatched_cells, samples AS n_samples FROM orders_in
UNION ALL
SELECT 'l' || p, 'sandbox_l' || p || '.out', gt_rows, out_rows, missing_rows, extra_rows, 'keyless-hash(%.9e)',
  missing_rows = 0 AND extra_rows = 0, NULL, 0 FROM per_line
UNION ALL
SELECT 'c' || p, 'sandbox_c' || p || '.out', n, n, 0, 0, 'keyed rel_tol=1e-09', true, 0, 0 FROM cust"""

ORACLE["csv_source"] = """
SELECT CAST(doc_id AS INTEGER) AS doc_id, md5('"a", b;' || chr(10) || text) AS text_md5, lang, doc_id + 1000000000000 AS wide,
  CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS DOUBLE) / 8 END AS ratio, doc_id % 2 = 0 AS even,
  CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS VARCHAR), 3, 'x') ELSE CAST(doc_id AS VARCHAR)[:3] END AS code FROM documents"""

# Type names of the engines, by the catalog.
ORACLE["table_schemas"] = """
WITH names AS (SELECT unnest(['customer', 'documents', 'embeddings', 'events', 'lineitem', 'orders']) AS t),
cols AS (
  SELECT table_name AS t, string_agg(column_name || ' ' || CASE data_type
    WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date'
    WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' WHEN 'FLOAT[]' THEN 'array<float>'
    WHEN 'DOUBLE[]' THEN 'array<double>' ELSE lower(data_type) END, ', ' ORDER BY ordinal_position) AS schema
  FROM information_schema.columns WHERE table_name IN (SELECT t FROM names) GROUP BY table_name),
n AS (
  SELECT 'customer' AS t, count(*) AS n_rows FROM customer UNION ALL SELECT 'documents', count(*) FROM documents
  UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events
  UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders)
SELECT 'schemas_' || t AS table_name, schema, n_rows FROM cols JOIN n USING (t)"""

ORACLE["catalog_parity"] = f"""
WITH {ORDERS_BAD}, {ORDERS_JOIN}, {ORDERS_SUMMARY}
SELECT 'p_views' AS program_id, 'parity_orders_out' AS table_name, gt_rows, out_rows, missing_rows, extra_rows,
  'keyed rel_tol=1e-09' AS method, gt_rows = out_rows AND missing_rows = 0 AND extra_rows = 0 AND mismatched_cells = 0 AS passed,
  CAST(mismatched_cells AS BIGINT) AS mismatched_cells, CAST(NULL AS BOOLEAN) AS inaccessible FROM orders_summary
UNION ALL
SELECT 'p_views', 'parity_lines_out', count(*), count(*), 0, 0, 'keyless-hash(%.9e)', true, NULL, NULL FROM lineitem
UNION ALL
SELECT 'p_views', 'parity_none', 0, 0, 0, 0, 'error', false, NULL, true"""

ORACLE["parquet_snapshot"] = f"""
WITH d AS ({_digest_sql("customer", DIGEST_TABLES["customer"])})
SELECT c_custkey, c_name, c_acctbal, d.digest FROM customer, d"""

ORACLE["inventory_status"] = """
WITH last AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1),
s AS (SELECT c_custkey, c_name, k, ['registered', 'landed', 'translated', 'validating', 'parity_pass', 'triage'][k % 6 + 1] AS st
      FROM customer LEFT JOIN last ON o_custkey = c_custkey)
SELECT 'c' || c_custkey AS program_id, c_name AS owner, coalesce(st, 'registered') AS status,
  CASE WHEN st = 'triage' THEN 'order ' || k END AS error FROM s"""

ORACLE["log_scan"] = f"""
WITH {CALLS}
SELECT program_id, event_id, purpose, error, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM calls"""

ORACLE["program_state"] = """
SELECT CASE event_type WHEN 'signup' THEN 'registered' WHEN 'view' THEN 'landed' WHEN 'click' THEN 'translated'
  WHEN 'purchase' THEN 'parity_pass' WHEN 'error' THEN 'triage' END AS status, event_id
FROM events WHERE user_id = 7 QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) = 1"""

ORACLE["sas_top"] = """
SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer
ORDER BY c_acctbal NULLS FIRST, c_custkey DESC LIMIT 500"""

ORACLE["parity_records"] = f"""
WITH t AS ({ORACLE["diff_text"]}), v AS ({ORACLE["grouped_parity"]})
SELECT v.program_id, CASE WHEN passed THEN 'parity_pass' ELSE 'triage' END AS status,
  CASE WHEN NOT passed THEN 'diverged' END AS failure_mode, gt_rows % 4 + 1 AS outer_attempts,
  CASE WHEN NOT passed THEN t.text END AS report
FROM v LEFT JOIN t USING (program_id)"""
