"""Migration bookkeeping as Spark tables.

Two table shapes hold JSON payloads, so their schema never changes as the
recorded fields evolve:

    key/value  (key STRING, payload STRING, updated_at TIMESTAMP)   upserted
    log        (payload STRING, ts TIMESTAMP)                        appended

Upserts work on whole batches: the union of the current rows and the
updates is reduced to the latest row per key in one aggregation (map-side
partial step, so a key updated a million times costs one row per task).
The functions map DataFrames to DataFrames; where a table is kept (a catalog
table, a Delta or Iceberg table, Parquet folders) is the caller's choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KV_COLS = ("key", "payload", "updated_at")
LOG_COLS = ("payload", "ts")
KV_SCHEMA = "key string, payload string, updated_at timestamp"
LOG_SCHEMA = "payload string, ts timestamp"

STATUSES = ("registered", "landed", "translated", "validating", "parity_pass", "triage")

PROGRAM_SCHEMA = T.StructType([
    T.StructField("program_id", T.StringType(), False),
    T.StructField("sas_path", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("inputs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ground_truth", T.MapType(T.StringType(), T.StringType())),
    T.StructField("keys", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("failure_mode", T.StringType()),
    T.StructField("float_rel_tol", T.DoubleType()),
])


# ---------------------------------------------------------------- shapes

def table_kind(df: DataFrame) -> str:
    cols = tuple(df.columns)
    if cols == KV_COLS:
        return "kv"
    if cols == LOG_COLS:
        return "log"
    raise ValueError(f"table has columns {cols}, expected {KV_COLS} (key/value) "
                     f"or {LOG_COLS} (log)")


def to_kv(df: DataFrame, key: str, ts: str | None = None) -> DataFrame:
    """Rows -> key/value shape: every other column goes into the JSON payload."""
    rest = [c for c in df.columns if c != ts]
    stamp = F.col(ts).cast("timestamp") if ts else F.current_timestamp()
    return df.select(F.col(key).cast("string").alias("key"),
                     F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("payload"),
                     stamp.alias("updated_at"))


def to_log(df: DataFrame, ts: str | None = None, keep_nulls: bool = False) -> DataFrame:
    """Rows -> log shape: every other column goes into the JSON payload
    (NULL fields written as ``null`` with ``keep_nulls``)."""
    rest = [c for c in df.columns if c != ts]
    stamp = F.col(ts).cast("timestamp") if ts else F.current_timestamp()
    opts = {"ignoreNullFields": "false"} if keep_nulls else None
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]), opts).alias("payload"),
                     stamp.alias("ts"))


# ---------------------------------------------------------------- K1 K2 K3 O3

def upsert(current: DataFrame | None, updates: DataFrame) -> DataFrame:
    """Key/value upsert: a matched key takes the update's payload and time,
    a new key is inserted. Among several updates of one key the latest
    ``updated_at`` wins (then the larger payload text, for determinism)."""
    table_kind(updates)
    u = updates.select(*KV_COLS, F.lit(1).alias("_src"))
    both = u if current is None else current.select(*KV_COLS, F.lit(0).alias("_src")).unionByName(u)
    rank = F.struct("_src", "updated_at", "payload")
    latest = both.groupBy("key").agg(F.max_by(F.struct("payload", "updated_at"), rank).alias("_r"))
    return latest.select("key", "_r.payload", "_r.updated_at")


def latest_by_time(kv_rows: DataFrame) -> DataFrame:
    """Replay a stream of key/value rows: the latest row per key by ``updated_at``."""
    rank = F.struct("updated_at", "payload")
    return (kv_rows.groupBy("key").agg(F.max_by(F.struct("payload", "updated_at"), rank).alias("_r"))
                   .select("key", "_r.payload", "_r.updated_at"))


def get(kv: DataFrame, key: str, schema) -> DataFrame:
    """The payload of one key, parsed with ``schema`` (zero rows when absent)."""
    return kv.filter(F.col("key") == F.lit(key)).select(F.from_json("payload", schema).alias("r")) \
             .select("r.*")


def scan(df: DataFrame | None, schema=None) -> DataFrame | None:
    """All payloads in time order (``updated_at`` for key/value, ``ts`` for logs);
    ``None`` (a missing table) stays ``None``. With ``schema`` the payload is parsed."""
    if df is None:
        return None
    order = "updated_at" if table_kind(df) == "kv" else "ts"
    out = df.orderBy(order)
    if schema is not None:
        out = out.select(F.from_json("payload", schema).alias("r"), order).select("r.*", order)
    return out


# ---------------------------------------------------------------- inventory K5 K6 K7 A11

def register(inventory: DataFrame | None, programs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Register programs not yet present. Returns (new inventory, outcome) where
    outcome has ``program_id, registered`` (False for an existing program)."""
    progs = programs.withColumn("status", F.coalesce(F.col("status"), F.lit("registered"))) \
        if "status" in programs.columns else programs.withColumn("status", F.lit("registered"))
    progs = _conform(progs)
    if inventory is None:
        return progs, progs.select("program_id", F.lit(True).alias("registered"))
    new = progs.join(inventory.select("program_id"), "program_id", "left_anti")
    outcome = progs.select("program_id").join(
        new.select("program_id", F.lit(True).alias("registered")), "program_id", "left") \
        .select("program_id", F.coalesce("registered", F.lit(False)).alias("registered"))
    return inventory.unionByName(new), outcome


def _conform(df: DataFrame) -> DataFrame:
    cols = []
    for f in PROGRAM_SCHEMA.fields:
        cols.append((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def set_status(inventory: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply ``program_id, status[, error, failure_mode]`` updates; status, error
    and failure mode are replaced together. An unknown status raises
    ``ValueError``, an unregistered program ``KeyError`` (nothing is applied)."""
    for c in ("error", "failure_mode"):
        if c not in updates.columns:
            updates = updates.withColumn(c, F.lit(None).cast("string"))
    bad = updates.filter(~F.col("status").isin(*STATUSES) | F.col("status").isNull()) \
                 .select("status").limit(1).collect()
    if bad:
        raise ValueError(f"unknown status {bad[0]['status']!r}; expected one of {STATUSES}")
    missing = updates.join(inventory.select("program_id"), "program_id", "left_anti") \
                     .select("program_id").limit(1).collect()
    if missing:
        raise KeyError(f"program {missing[0]['program_id']!r} not registered")
    u = updates.select("program_id", F.col("status").alias("_s"), F.col("error").alias("_e"),
                       F.col("failure_mode").alias("_f"), F.lit(True).alias("_hit"))
    j = inventory.join(u, "program_id", "left")
    return j.select(*[
        (F.when(F.col("_hit"), F.col(src)).otherwise(F.col(f.name)).alias(f.name)
         if (src := {"status": "_s", "error": "_e", "failure_mode": "_f"}.get(f.name))
         else F.col(f.name)) for f in PROGRAM_SCHEMA.fields])


def pending(inventory: DataFrame, status_col: str = "status") -> DataFrame:
    """Programs still to do: status is not ``parity_pass`` (missing counts)."""
    return inventory.filter(~F.col(status_col).eqNullSafe(F.lit("parity_pass")))


def funnel(df: DataFrame, status_col: str = "status") -> DataFrame:
    """Programs per status, ordered by status."""
    return df.groupBy(F.col(status_col).alias("status")).agg(F.count(F.lit(1)).alias("n")) \
             .orderBy("status")
