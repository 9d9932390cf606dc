"""DataFrame operators with SAS DATA step and PROC semantics.

Row order: SAS relies on physical order, Spark has none, so every ordered
operator takes explicit ``order`` columns that must break ties.
Skew: BY-group scans go through :func:`paritas.operators.scan.ordered_scan`
(hot groups split across chunks); keep-first and statistics use map-side
partial aggregation; the 1:n merge streams the n side through a left join
that adaptive execution can split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritas.functions.sas import sas_sort_order
from paritas.operators.scan import _join_null_safe, ordered_scan

def _cols(names) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


# ---------------------------------------------------------------- O1, P9

def sas_sort(df: DataFrame, spec) -> DataFrame:
    """PROC SORT order: missing lowest; ``spec`` entries are names or (name, 'desc')."""
    return df.orderBy(*sas_sort_order(df, spec))


def data_step_where(df: DataFrame, predicate: Column) -> DataFrame:
    """``SET ...; WHERE <predicate>;`` where the predicate uses the missing-aware
    comparisons of :mod:`paritas.functions.sas` (they never yield NULL)."""
    return df.filter(F.coalesce(predicate, F.lit(False)))


_WHERE_OPS = {
    # op: (plain comparison, whether a missing value satisfies it)
    ">": (lambda c, v: c > v, False), ">=": (lambda c, v: c >= v, False),
    "=": (lambda c, v: c == v, False), "<": (lambda c, v: c < v, True),
    "<=": (lambda c, v: c <= v, True), "^=": (lambda c, v: c != v, True),
}


def where_sas(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """``WHERE column <op> value`` for a non-missing constant, SAS rules
    (missing is lower than every value), written so Parquet can push it
    down: ``c > v`` stays a plain comparison (a missing ``c`` drops out as
    SAS drops it), ``c < v`` becomes ``c IS NULL OR c < v``."""
    if value is None:
        raise ValueError("compare with a missing value through sas_eq/sas_ne")
    cmp, keeps_missing = _WHERE_OPS[op]
    c = F.col(f"`{column}`")
    cond, missing = cmp(c, F.lit(value)), c.isNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        missing, cond = missing | F.isnan(c), cond & ~F.isnan(c)
    return df.filter(missing | cond if keeps_missing else cond)


# ---------------------------------------------------------------- W1, W2

def first_last(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add ``first_<v>`` / ``last_<v>`` flags for every BY variable ``v``.

    FIRST.v is true on the first row of the group formed by the BY variables
    up to and including ``v`` (SAS semantics for several BY variables). The
    ends of the innermost groups are the least and greatest order values, a
    map-side combined aggregation; outer levels are found on its result; one
    join brings all ends back to the rows. No row is sorted or written, and a
    group with a third of all rows is one row of the aggregation.
    """
    place = F.struct(*_cols(order))
    ends = df.groupBy(*_cols(by)).agg(F.min(place).alias(f"_lo{len(by) - 1}"), F.max(place).alias(f"_hi{len(by) - 1}"))
    inner = ends
    for i in range(len(by) - 1):
        at = lambda end: F.struct(*_cols(by[i + 1:]), F.col(end))  # noqa: B023, E731
        outer = inner.groupBy(*_cols(by[:i + 1])).agg(F.min(at(f"_lo{len(by) - 1}")).alias(f"_lo{i}"), F.max(at(f"_hi{len(by) - 1}")).alias(f"_hi{i}"))
        ends = _join_null_safe(ends, outer, by[:i + 1])
    x = _join_null_safe(df, ends, by)
    flags = []
    for i, v in enumerate(by):
        here = place if i == len(by) - 1 else F.struct(*_cols(by[i + 1:]), place)
        flags += [here.eqNullSafe(F.col(f"_lo{i}")).alias(f"first_{v}"), here.eqNullSafe(F.col(f"_hi{i}")).alias(f"last_{v}")]
    return x.select(*_cols(df.columns), *flags)


def data_step(df: DataFrame, by: list[str], order: list[str], *,
              retain: dict[str, str] | None = None, sums: dict[str, Column] | None = None,
              flags: bool = False, num_chunks: int | None = None) -> DataFrame:
    """One BY-group pass of a DATA step: RETAIN carries (``{out: col}``), sum
    statements (``{out: expr}``) and, with ``flags``, FIRST./LAST. of the
    innermost BY variable, from a single chunking of the rows."""
    inner = by[-1] if by else "all"
    return ordered_scan(df, by, order, locf={o: F.col(f"`{c}`") for o, c in (retain or {}).items()},
                        sums=sums, first=f"first_{inner}" if flags else None,
                        last=f"last_{inner}" if flags else None, num_chunks=num_chunks)


def retain(df: DataFrame, by: list[str], order: list[str], columns: dict[str, str],
           num_chunks: int | None = None) -> DataFrame:
    """RETAIN: ``{out: col}`` carries the last non-missing ``col`` down the group."""
    return data_step(df, by, order, retain=columns, num_chunks=num_chunks)


def running_total(df: DataFrame, by: list[str], order: list[str], totals: dict[str, Column],
                  num_chunks: int | None = None) -> DataFrame:
    """Sum statement (``total + x;``): running sum per group, missing adds 0."""
    return data_step(df, by, order, sums=totals, num_chunks=num_chunks)


# ---------------------------------------------------------------- W3

def nodupkey(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """PROC SORT NODUPKEY: the first row per BY key in ``order``.

    Deterministic even with ties: the remaining columns break them. Runs as
    one aggregation with a map-side partial step, so a key with a huge number
    of rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in by and c not in order]
    row = F.struct(*_cols(df.columns))
    rank = F.struct(*_cols(order + rest))
    return (df.groupBy(*_cols(by)).agg(F.min_by(row, rank).alias("_r"))
              .select("_r.*"))


# ---------------------------------------------------------------- A6, A7, A8

STAT_FUNCS = {
    "n": lambda c: F.count(c),
    "nmiss": lambda c: F.count_if(c.isNull()),
    "mean": lambda c: F.avg(c),
    "std": lambda c: F.stddev_samp(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "sum": lambda c: F.sum(c),
    "var": lambda c: F.var_samp(c),
    "range": lambda c: F.max(c) - F.min(c),
}
DEFAULT_STATS = ("n", "mean", "std", "min", "max")


def _nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def proc_means(df: DataFrame, variables: list[str], class_vars: list[str] | None = None,
               stats=DEFAULT_STATS) -> DataFrame:
    """PROC MEANS printed table: per class group, ``<var>_<stat>`` columns.
    Missing values (NULL, NaN) are excluded from the statistics."""
    aggs = [STAT_FUNCS[s](_nan_to_null(F.col(f"`{v}`").cast("double"))).alias(f"{v}_{s}")
            for v in variables for s in stats]
    g = df.groupBy(*_cols(class_vars or []))
    return g.agg(*aggs)


def proc_means_output(df: DataFrame, class_vars: list[str], outputs: dict[str, tuple[str, str]],
                      nway: bool = False, missing: bool = False) -> DataFrame:
    """``OUTPUT OUT=`` table of PROC MEANS/SUMMARY with ``_TYPE_`` and ``_FREQ_``.

    outputs  ``{out_name: (stat, var)}``, e.g. ``{"avg_balance": ("mean", "balance")}``
    One row per combination of class variables (all subsets, as SAS does
    without NWAY); ``_TYPE_`` has bit ``k-1-i`` set when class variable ``i``
    is part of the row's grouping; ``_FREQ_`` counts rows. ``nway`` keeps only
    the full combination. Rows with a missing class value are left out of
    every row, as in SAS, unless ``missing``.
    """
    k = len(class_vars)
    if not missing:
        for c in class_vars:
            x = F.col(f"`{c}`")
            nan = F.isnan(x) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.lit(False)
            df = df.filter(x.isNotNull() & ~nan)
    aggs = [F.count(F.lit(1)).alias("_FREQ_")]
    aggs += [STAT_FUNCS[s](_nan_to_null(F.col(f"`{v}`").cast("double"))).alias(name)
             for name, (s, v) in outputs.items()]
    if k == 0:
        return df.agg(*aggs).select(F.lit(0).alias("_TYPE_"), "*")
    cube = df.cube(*_cols(class_vars)).agg(F.grouping_id().alias("_gid"), *aggs)
    out = cube.select(*_cols(class_vars),
                      (F.lit((1 << k) - 1) - F.col("_gid")).cast("int").alias("_TYPE_"),
                      "_FREQ_", *[F.col(f"`{n}`") for n in outputs])
    if nway:
        out = out.filter(F.col("_TYPE_") == (1 << k) - 1)
    return out


def proc_sql_count(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """``select <by>, count(*) as n ... group by <by>``."""
    return df.groupBy(*_cols(by)).agg(F.count(F.lit(1)).alias(name))


# ---------------------------------------------------------------- A9

def proc_freq(df: DataFrame, var: str, missing: bool = False,
              num_chunks: int | None = None) -> DataFrame:
    """One-way PROC FREQ: frequency, percent, cumulative frequency and percent
    by ascending level. Missing levels are left out unless ``missing``."""
    src = df if missing else df.filter(F.col(f"`{var}`").isNotNull())
    freq = src.groupBy(F.col(f"`{var}`")).agg(F.count(F.lit(1)).alias("frequency"))
    scanned = ordered_scan(freq, [], [var], sums={"cum_frequency": F.col("frequency")},
                           totals=["cum_frequency"], num_chunks=num_chunks)
    total = F.col("cum_frequency_total")
    return scanned.select(
        F.col(f"`{var}`"), F.col("frequency").cast("long").alias("frequency"),
        (F.col("frequency") * 100.0 / total).alias("percent"),
        F.col("cum_frequency").cast("long").alias("cum_frequency"),
        (F.col("cum_frequency") * 100.0 / total).alias("cum_percent"))


def proc_freq_2way(df: DataFrame, row_var: str, col_var: str) -> DataFrame:
    """Two-way PROC FREQ cells: frequency, percent of total, row and column percent.

    Row and column totals come from one cube over the cell table and are
    joined on their level; the grand total is a single number read with one
    small aggregation (no cross join)."""
    src = df.filter(F.col(f"`{row_var}`").isNotNull() & F.col(f"`{col_var}`").isNotNull())
    cells = src.groupBy(F.col(f"`{row_var}`"), F.col(f"`{col_var}`")).agg(
        F.count(F.lit(1)).alias("frequency"))
    tot = cells.cube(F.col(f"`{row_var}`"), F.col(f"`{col_var}`")).agg(
        F.grouping_id().alias("_gid"), F.sum("frequency").alias("_t"))
    rows = tot.filter("_gid = 1").select(F.col(f"`{row_var}`").alias("_rv"), F.col("_t").alias("_row_total"))
    cols = tot.filter("_gid = 2").select(F.col(f"`{col_var}`").alias("_cv"), F.col("_t").alias("_col_total"))
    total = cells.agg(F.sum("frequency")).first()[0] or 0
    out = (cells.join(rows, F.col(f"`{row_var}`") == F.col("_rv"))
                .join(cols, F.col(f"`{col_var}`") == F.col("_cv")))
    return out.select(
        F.col(f"`{row_var}`"), F.col(f"`{col_var}`"), F.col("frequency").cast("long").alias("frequency"),
        (F.col("frequency") * 100.0 / F.lit(float(total))).alias("percent"),
        (F.col("frequency") * 100.0 / F.col("_row_total")).alias("row_percent"),
        (F.col("frequency") * 100.0 / F.col("_col_total")).alias("col_percent"))


# ---------------------------------------------------------------- A10

def _id_name(v) -> str:
    s = str(v)
    return s if s[:1].isalpha() or s[:1] == "_" else "_" + s


def transpose_wide(df: DataFrame, by: list[str], id_col: str, var: str,
                   values: list | None = None, let: bool = False) -> DataFrame:
    """PROC TRANSPOSE long -> wide: ``BY by; ID id_col; VAR var;``.

    One output column per ID value (numbers get a ``_`` prefix, as in SAS),
    plus ``_NAME_`` holding the VAR name. The ID values become columns, so
    they are read with one distinct query unless ``values`` gives them. As in
    SAS a repeated or missing ID within a BY group is an error; with ``let``
    the largest value of a repeated ID stays and a missing ID becomes the
    column ``_``. ID values that give the same name in any case are an error.
    """
    ids = F.col(f"`{id_col}`")
    if not let:
        wrong = df.groupBy(*_cols(by), ids).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | ids.isNull())
        first = wrong.limit(1).collect()
        if first:
            raise ValueError(f"ID {id_col} is missing or occurs more than once in a BY group: {first[0].asDict()}")
    if values is None:
        values = sorted((r[0] for r in df.select(id_col).distinct().collect()), key=lambda v: (v is None, v))
    names = ["_" if v is None else _id_name(v) for v in values]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"values of {id_col} give the same column name")
    aggs = [F.max(F.when(ids.eqNullSafe(F.lit(v)), F.col(f"`{var}`"))).alias(n) for v, n in zip(values, names)]
    return df.groupBy(*_cols(by)).agg(*aggs).select(*_cols(by), F.lit(var).alias("_NAME_"), *_cols(names))


def transpose_long(df: DataFrame, by: list[str], variables: list[str]) -> DataFrame:
    """PROC TRANSPOSE wide -> long: one row per (BY group, VAR) with ``_NAME_``
    and ``COL1``. Narrow: no shuffle."""
    cast = df.select(*_cols(by), *[F.col(f"`{v}`").cast("double").alias(v) for v in variables])
    return cast.unpivot(by, variables, "_NAME_", "COL1")


# ---------------------------------------------------------------- J3

#: Rows of one BY value up to which a merge is one full join; a larger group
#: has to be split, which a full join can't.
MERGE_GROUP_ROWS = 1_000_000


def merge_by(left: DataFrame, right: DataFrame, by: list[str],
             in_left: str = "in_left", in_right: str = "in_right", group_rows: int = MERGE_GROUP_ROWS) -> DataFrame:
    """DATA step match-merge ``MERGE left right; BY by;`` for 1:1 and 1:n.

    Shared non-BY columns take the right value when a right row exists. n:m
    (duplicate keys on both sides) raises, which one job over the key columns
    finds out. Each side is then read once, by a full join on the keys. Where a
    BY value has more than ``group_rows`` rows, the side with duplicate keys is
    streamed through a left join instead (adaptive execution splits a hot key)
    and the unmatched rows of the unique side are added with an anti join
    against the distinct keys; the result is the same.
    """
    from paritas.operators.compare import key_stats
    ks = key_stats(left, right, by).first()      # one job: both sides' largest key group
    lmax, rmax = ks["gt_max_dup"], ks["out_max_dup"]
    if lmax > 1 and rmax > 1:
        raise ValueError("MERGE with duplicate BY values on both sides (n:m) is not supported")
    lcols = [c for c in left.columns if c not in by]
    rcols = [c for c in right.columns if c not in by]
    L = left.select(*_cols(by), *[F.col(f"`{c}`").alias("l__" + c) for c in lcols],
                    F.lit(True).alias("_in_l"))
    R = right.select(*[F.col(f"`{c}`").alias("r__" + c) for c in by],
                     *[F.col(f"`{c}`").alias("r__" + c) for c in rcols], F.lit(True).alias("_in_r"))
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`r__{k}`")) for k in by])
    if max(lmax, rmax) <= group_rows:
        streamed, only = L.join(R, on, "full_outer"), None
    # Stream the side that may repeat keys (left when neither does).
    elif rmax > 1:
        streamed = R.join(L, on, "left")
        keys_r = R.select(*[F.col(f"`r__{k}`") for k in by]).distinct()
        only = L.join(keys_r, on, "left_anti")
    else:
        streamed = L.join(R, on, "left")
        keys_l = L.select(*_cols(by)).distinct()
        only = R.join(keys_l, on, "left_anti")
    both = streamed if only is None else streamed.unionByName(only, allowMissingColumns=True)
    # A left-less row carries its BY values only on the right side.
    out = [F.when(F.col("_in_l").isNotNull(), F.col(f"`{k}`")).otherwise(F.col(f"`r__{k}`")).alias(k)
           for k in by]
    for c in lcols:
        if c in rcols:
            out.append(F.when(F.col("_in_r").isNotNull(), F.col(f"`r__{c}`"))
                       .otherwise(F.col(f"`l__{c}`")).alias(c))
        else:
            out.append(F.col(f"`l__{c}`").alias(c))
    out += [F.col(f"`r__{c}`").alias(c) for c in rcols if c not in lcols]
    out += [F.col("_in_l").isNotNull().alias(in_left), F.col("_in_r").isNotNull().alias(in_right)]
    return both.select(*out)
