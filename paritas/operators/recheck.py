"""Re-checks that read only what changed.

A bucketed snapshot keeps a table cut by a hash of its keys, one folder per
bucket, and beside the data one digest per bucket: the sums of its rows' hashes
(see ``snapshot``), so that a bucket's digest does not depend on row order or
files. Two snapshots with the same keys and buckets hold a key in the same
bucket, so buckets with equal digests hold equal rows, and parity needs to
read the others alone. The driver sees bucket numbers, a bounded number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritas.operators import compare as C
from paritas.sources.snapshot import complete, digests

BUCKET = "_bucket"
BUCKETS = 256


def with_bucket(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int"))


def bucket_digests(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``_bucket``, ``n_rows`` and ``digest`` of every bucket that has rows: one
    aggregation with map-side partial sums. Columns count by name, in any
    order; NaN and null differ, as they do in a comparison."""
    names = sorted(df.columns, key=str.lower)
    return digests(with_bucket(df, keys, buckets), names, [BUCKET], nan_as_null=False).select(BUCKET, "n_rows", "digest")


def table_digest(per_bucket: DataFrame) -> DataFrame:
    """One row: ``n_rows`` and the ``digest`` over all buckets' digests."""
    line = F.concat_ws(":", BUCKET, "n_rows", "digest")
    return per_bucket.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("n_rows"),
                          F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256).alias("digest"))


def bucketed_snapshot(df: DataFrame, name: str, root: str, keys: list[str], buckets: int = BUCKETS) -> str:
    """Write ``df`` once under ``<root>/<name>_<digest>`` (skipped when that
    folder holds a complete snapshot) and return the folder. A large bucket is
    written by several tasks (``rebalance``), so a hot key fills no single one."""
    spark = df.sparkSession
    per_bucket = bucket_digests(df, keys, buckets)
    note = table_digest(per_bucket).first()
    path = f"{root.rstrip('/')}/{name}_{note['digest']}"
    if not complete(spark, path):
        with_bucket(df, keys, buckets).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/data")
        per_bucket.write.mode("overwrite").parquet(f"{path}/digests")
        spark.createDataFrame([(note["n_rows"], note["digest"], keys, buckets, df.schema.json())],
                              "n_rows long, digest string, keys array<string>, buckets int, schema string") \
            .write.mode("overwrite").parquet(f"{path}/complete")
    return path


def _note(spark: SparkSession, path: str) -> dict:
    if not complete(spark, path):
        raise ValueError(f"no complete bucketed snapshot at {path}")
    return spark.read.parquet(f"{path}/complete").first().asDict()


def read_buckets(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """The rows of a bucketed snapshot, or of the wanted buckets: a filter on
    the folders' column, so other folders are not opened."""
    import json

    schema = T.StructType.fromJson(json.loads(_note(spark, path)["schema"]))
    x = spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(f"{path}/data")
    return (x if wanted is None else x.where(F.col(BUCKET).isin(wanted))).drop(BUCKET)


def changed_buckets(spark: SparkSession, gt_path: str, out_path: str) -> tuple[list[int], int]:
    """Buckets whose digests differ, and the rows of all others."""
    g, o = (spark.read.parquet(f"{p}/digests").select(F.col(BUCKET), F.struct("n_rows", "digest").alias(s))
            for p, s in ((gt_path, "g"), (out_path, "o")))
    both = g.join(o, BUCKET, "full_outer")
    same = F.col("g").eqNullSafe(F.col("o"))
    row = both.agg(F.sort_array(F.collect_list(F.when(~same, F.col(BUCKET)))).alias("changed"),
                   F.coalesce(F.sum(F.when(same, F.col("g.n_rows"))), F.lit(0)).alias("rows")).first()
    return row["changed"], row["rows"]


def recheck(spark: SparkSession, gt_path: str, out_path: str, rel_tol: float = 1e-9) -> DataFrame:
    """One row as :func:`compare.keyed_summary` gives it for the whole tables,
    from two bucketed snapshots, reading only buckets that differ."""
    a, b = _note(spark, gt_path), _note(spark, out_path)
    kinds = [{f["name"]: f["type"] for f in _fields(n)} for n in (a, b)]
    if (a["keys"], a["buckets"]) != (b["keys"], b["buckets"]) or any(kinds[0][k] != kinds[1].get(k) for k in a["keys"]):
        raise ValueError("the snapshots are cut by different keys, key types or numbers of buckets")
    wanted, rows = changed_buckets(spark, gt_path, out_path)
    keys = [k.lower() for k in a["keys"]]
    pair = C.align(read_buckets(spark, gt_path, wanted), read_buckets(spark, out_path, wanted), keys)
    s = C.keyed_summary(pair, keys, rel_tol)
    return s.select(*[(F.col(c) + F.lit(rows)).alias(c) if c in ("gt_rows", "out_rows", "matched_rows") else F.col(c) for c in s.columns])


def _fields(note: dict) -> list[dict]:
    import json

    return json.loads(note["schema"])["fields"]
