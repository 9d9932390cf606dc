"""Order-insensitive table fingerprints and content-named snapshots.

A row's line holds its values in column order, each as ``length:text`` (so a
NULL, written ``~``, the empty text and any separator stay apart; NaN counts as
NULL). Every line is hashed with SHA-256, the four 64-bit pieces of the hash
are summed over all rows, and the column names, row count and sums are hashed
again. One aggregation with map-side partial sums for any size: duplicates
count, order does not.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEP = "\x1f"
PIECES = 4


def row_text(df: DataFrame, nan_as_null: bool = True) -> Column:
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if nan_as_null and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.concat_ws(SEP, *parts) if parts else F.lit("")


def digests(df: DataFrame, cols: list[str], by: list[str], nan_as_null: bool = True) -> DataFrame:
    """``by``, ``n_rows``, ``hash_sum`` and ``digest`` of the rows of each group."""
    h = F.sha2(row_text(df.select(*[F.col(f"`{c}`") for c in cols]), nan_as_null), 256)
    x = df.select(*[F.col(f"`{c}`") for c in by], h.alias("_h"))
    pieces = [F.sum(F.conv(F.substring("_h", 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")) for i in range(PIECES)]
    zero = F.lit(0).cast("decimal(38,0)")
    s = x.groupBy(*[F.col(f"`{c}`") for c in by]).agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.concat_ws("|", *[F.coalesce(p, zero).cast("string") for p in pieces]).alias("hash_sum"))
    return s.withColumn("digest", F.sha2(F.concat_ws(
        "|", F.lit(",".join(cols)), F.col("n_rows").cast("string"), F.col("hash_sum")), 256))


def content_digest(df: DataFrame) -> DataFrame:
    """One row: n_rows, hash_sum (the sums, joined by ``|``) and ``digest``
    (64 hex digits)."""
    return digests(df, df.columns, [])


def grouped_content_digest(df: DataFrame, group: str) -> DataFrame:
    """:func:`content_digest` of every ``group`` value's rows in one
    aggregation (the group column itself is not part of the row text)."""
    return digests(df, [c for c in df.columns if c != group], [group])


def complete(spark: SparkSession, path: str) -> bool:
    """True when ``path`` was written to its end: the note beside the data is
    written last."""
    try:
        return not spark.read.parquet(f"{path}/complete").isEmpty()
    except AnalysisException:
        return False


def snapshot(df: DataFrame, name: str, root: str) -> tuple[str, str]:
    """Write ``df`` once under ``<root>/<name>_<digest>/data`` (skipped when
    that folder holds a complete snapshot). Returns (path of the data, digest);
    the digest is the whole SHA-256, so equal names are equal contents."""
    note = content_digest(df).first()
    path = f"{root.rstrip('/')}/{name}_{note['digest']}"
    if not complete(df.sparkSession, path):
        df.write.mode("overwrite").parquet(f"{path}/data")   # absent or unfinished
        df.sparkSession.createDataFrame([tuple(note)], "n_rows long, hash_sum string, digest string") \
            .write.mode("overwrite").parquet(f"{path}/complete")
    return f"{path}/data", note["digest"]
