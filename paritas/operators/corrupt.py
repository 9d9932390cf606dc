"""Deterministic corruption of a table, to prove the parity check catches it.

Every change is decided by the value of an integer key modulo a number, so
the same corrupted copy is produced on every run, every partitioning and in
the SQL oracle. All steps are narrow (no shuffle) except ``swap``, which
exchanges a column between key ``k`` and key ``k + 1`` through one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corrupt(df: DataFrame, key: str, *, drop_mod: int | None = None,
            perturb: dict[str, int] | None = None, relabel: dict[str, int] | None = None,
            extra_mod: int | None = None, swap: tuple[str, int] | None = None,
            perturb_by: float = 1.0) -> DataFrame:
    """Corrupted copy of ``df``.

    drop_mod    drop rows whose ``key % drop_mod == 0``            -> missing rows
    perturb     ``{col: m}``: add ``perturb_by`` where ``key % m == 0`` -> float mismatches
    relabel     ``{col: m}``: append ``*`` to text where ``key % m == 0`` -> text mismatches
    extra_mod   add a copy of rows with ``key % extra_mod == 0`` under key
                ``-key - 1`` (never an existing key)              -> extra rows
    swap        ``(col, m)``: exchange ``col`` between keys ``k`` and ``k+1``
                where ``k % m == 0`` and both rows exist
    """
    k = F.col(key)
    out = df
    if swap:
        col, m = swap
        # Pair p = (p, p + 1) with p % m == 0; each member takes the other's value.
        lo = df.filter(k % m == 0).select(k.alias("_pair"), (k + 1).alias("_sk"),
                                          F.col(col).alias("_sv"))
        hi = df.filter(k % m == 1).select((k - 1).alias("_pair"), (k - 1).alias("_sk"),
                                          F.col(col).alias("_sv"))
        pairs = lo.unionByName(hi)
        complete = pairs.groupBy("_pair").count().filter("count = 2").select("_pair")
        swaps = pairs.join(complete, "_pair").select("_sk", "_sv")
        out = (out.join(swaps, k == F.col("_sk"), "left")
                  .select(*[F.when(F.col("_sk").isNotNull(), F.col("_sv")).otherwise(F.col(c)).alias(c)
                            if c == col else F.col(c) for c in df.columns]))
    if drop_mod:
        out = out.filter(k % drop_mod != 0)
    for col, m in (perturb or {}).items():
        out = out.withColumn(col, F.when(k % m == 0, F.col(col) + F.lit(perturb_by))
                             .otherwise(F.col(col)))
    for col, m in (relabel or {}).items():
        out = out.withColumn(col, F.when(k % m == 0, F.concat(F.col(col), F.lit("*")))
                             .otherwise(F.col(col)))
    if extra_mod:
        extra = df.filter(k % extra_mod == 0).withColumn(key, -k - 1)
        out = out.unionByName(extra)
    return out
