"""Ordered scans over BY groups that stay parallel when one group is huge.

SAS DATA steps walk rows in BY-group order (FIRST./LAST., RETAIN, sum
statements). A window ``partitionBy(by).orderBy(order)`` puts each group in
one task, so a group holding a third of the table would become a single
task. Instead:

1. Split points cut the ordered rows into ``n`` contiguous chunks; a hot group
   spans many chunks. They are the quantiles of a bounded sample of the
   (by, order) keys: those with the smallest hashes, so the sample is the same
   whenever it is taken, and one top-k per task finds it.
2. A row's chunk is a column expression: a binary search in the split points.
   It depends on the row alone, so every reader of the table sees the same
   chunks, and nothing has to be written in between.
3. Inside each (group, chunk) a window computes the local running values.
4. A per-(group, chunk) summary (at most ``#groups + n`` rows) gives each chunk
   its carry-in from the earlier chunks of the same group.
5. One equi-join on (group, chunk) adds the carry-in to the local values.

Steps 3 and 4 each read the rows. Split points are read while the plan is
built (one job over the key columns; at most ``SAMPLE_PER_CHUNK`` keys per chunk
come to the driver).

The order columns must make rows unique within a group (a tie-break), and
sort ascending with missing values first, as SAS does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = "_chunk"
#: Keys sampled for each chunk: a chunk's size is off by a tenth or so.
SAMPLE_PER_CHUNK = 64


CHUNKS_PER_PARTITION = 4


def default_chunks(df: DataFrame) -> int:
    """Four chunks per shuffle partition: the per-chunk windows hash
    (group, chunk) into the shuffle partitions, and smaller chunks spread a
    hot group's rows evenly (see SKEW.md: largest task 1.5x an even share
    with four, 2.8x with one, 11x for a plain window)."""
    return CHUNKS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    r = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") if c in keys else F.col(f"`{c}`")
                       for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`")) for k in keys])
    return left.join(r, cond, "inner").drop(*[f"_r_{k}" for k in keys])


def split_points(df: DataFrame, sort_cols: list[str], num_chunks: int) -> list[Row]:
    """At most ``num_chunks - 1`` keys that cut the rows into even chunks."""
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(sort_cols)])
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE_PER_CHUNK * num_chunks)
    keys = sample.agg(F.array_sort(F.collect_list("k")).alias("k")).first()["k"]
    cuts = [keys[len(keys) * i // num_chunks] for i in range(1, num_chunks)] if keys else []
    return [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]


def chunk_of(df: DataFrame, sort_cols: list[str], cuts: list[Row]) -> Column:
    """The number of split points that are not above the row's key."""
    if not cuts:
        return F.lit(0)
    types = [df.schema[c].dataType for c in sort_cols]
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(sort_cols)])
    at = [F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(c, types, strict=True))]) for c in cuts]
    points = F.array(*at)  # constant: folded once
    n = len(cuts)
    # In each step the answer lies in [low, high].
    middle = lambda x: F.floor((x["low"] + x["high"]) / 2).cast("int")
    step = lambda x, _: F.when(x["low"] == x["high"], x).when(
        F.get(points, middle(x)) <= x["key"], F.struct((middle(x) + 1).alias("low"), x["high"].alias("high"), x["key"].alias("key"))).otherwise(
        F.struct(x["low"].alias("low"), middle(x).alias("high"), x["key"].alias("key")))
    start = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"), key.alias("key"))
    return F.aggregate(F.array(*[F.lit(0)] * n.bit_length()), start, step, lambda x: x["low"])


def chunk(df: DataFrame, sort_cols: list[str], num_chunks: int | None = None) -> DataFrame:
    """Rows with a ``_chunk`` id: contiguous chunks of ``sort_cols`` order."""
    cuts = split_points(df, sort_cols, num_chunks or default_chunks(df))
    return df.withColumn(CHUNK, chunk_of(df, sort_cols, cuts))


def ordered_scan(df: DataFrame, by: list[str], order: list[str], *,
                 sums: dict[str, Column] | None = None,
                 locf: dict[str, Column] | None = None,
                 totals: list[str] | None = None,
                 position: str | None = None,
                 first: str | None = None, last: str | None = None,
                 num_chunks: int | None = None) -> DataFrame:
    """Add running values per BY group in ``order``.

    sums      ``{out: expr}`` running (inclusive) sum of ``expr``; NULL adds 0
    locf      ``{out: expr}`` last non-missing value of ``expr`` so far
    totals    names from ``sums`` whose whole-group total is added as ``<name>_total``
    position  name of a 1-based row-number column within the group
    first     name of a FIRST.-flag column (first row of the group)
    last      name of a LAST.-flag column (last row of the group)
    """
    sums, locf = sums or {}, locf or {}
    x = df
    for name, e in sums.items():
        x = x.withColumn(f"_s_{name}", F.coalesce(e, F.lit(0)))
    for name, e in locf.items():
        x = x.withColumn(f"_l_{name}", e)
    x = chunk(x, by + order, num_chunks)
    out = scan_chunked(x, by, order, sums=list(sums), locf=list(locf), totals=totals,
                       position=position, first=first, last=last)
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      *[c for c in out.columns if c not in x.columns])


def scan_chunked(x: DataFrame, by: list[str], order: list[str], *,
                 sums: list[str] = (), locf: list[str] = (), totals: list[str] | None = None,
                 position: str | None = None, first: str | None = None,
                 last: str | None = None) -> DataFrame:
    """The scan on rows already cut by :func:`chunk` on ``by + order`` (or on
    any sort key list that starts with ``by`` and then ``order``, so one
    chunking serves every BY level). Inputs ``_s_<name>`` / ``_l_<name>``
    must exist for the named sums and carries; all input columns are kept.
    """
    keys = list(by) + [CHUNK]
    base_cols = x.columns
    wpart = Window.partitionBy(*[F.col(f"`{c}`") for c in keys]).orderBy(
        *[F.col(f"`{c}`").asc_nulls_first() for c in order])
    wrun = wpart.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tag = "_".join(by) or "all"
    lrn = f"_lrn_{tag}"
    x = x.withColumn(lrn, F.row_number().over(wpart))
    for name in sums:
        x = x.withColumn(f"_ls_{name}", F.sum(f"_s_{name}").over(wrun))
    for name in locf:
        x = x.withColumn(f"_ll_{name}", F.last(f"_l_{name}", ignorenulls=True).over(wrun))

    ord_struct = F.struct(*[F.col(f"`{c}`") for c in order])
    aggs = [F.count(F.lit(1)).alias("_cn")]
    aggs += [F.sum(f"_s_{name}").alias(f"_cs_{name}") for name in sums]
    aggs += [F.max_by(F.col(f"_l_{name}"), F.when(F.col(f"_l_{name}").isNotNull(), ord_struct))
              .alias(f"_cl_{name}") for name in locf]
    summ = x.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(*aggs)

    grp = Window.partitionBy(*[F.col(f"`{c}`") for c in by])
    before = grp.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    summ = (summ.withColumn("_ci_n", F.coalesce(F.sum("_cn").over(before), F.lit(0)))
                .withColumn("_first_chunk", F.min(CHUNK).over(grp))
                .withColumn("_last_chunk", F.max(CHUNK).over(grp)))
    for name in sums:
        summ = summ.withColumn(f"_ci_{name}", F.coalesce(F.sum(f"_cs_{name}").over(before), F.lit(0)))
    for name in totals or []:
        summ = summ.withColumn(f"_tot_{name}", F.sum(f"_cs_{name}").over(grp))
    for name in locf:
        summ = summ.withColumn(f"_cil_{name}", F.last(f"_cl_{name}", ignorenulls=True).over(before))

    j = _join_null_safe(x, summ, keys)
    out = [F.col(f"`{c}`") for c in base_cols]
    for name in sums:
        out.append((F.col(f"_ls_{name}") + F.col(f"_ci_{name}")).alias(name))
    for name in totals or []:
        out.append(F.col(f"_tot_{name}").alias(f"{name}_total"))
    for name in locf:
        out.append(F.coalesce(F.col(f"_ll_{name}"), F.col(f"_cil_{name}")).alias(name))
    if position:
        out.append((F.col(lrn) + F.col("_ci_n")).cast("long").alias(position))
    if first:
        out.append(((F.col(CHUNK) == F.col("_first_chunk")) & (F.col(lrn) == 1)).alias(first))
    if last:
        out.append(((F.col(CHUNK) == F.col("_last_chunk")) & (F.col(lrn) == F.col("_cn")))
                   .alias(last))
    return j.select(*out)
