"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.session import ensure_checkpoint_dir

#: A word, as a regular expression that Python, Java and SQL engines share.
WORD = r"[^\x20\x09-\x0D]+"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the Arrow-fed operators rely on: batches bounded in rows and
    bytes (whole texts can be long), and this package importable in the
    Python workers even when the driver was started in another folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    ensure_checkpoint_dir(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder for one written table."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, block_bytes: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is
    cut and lost executors cost a read, not a recomputation. Tables with large
    cells take smaller row groups (``block_bytes``)."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.write.option("parquet.block.size", str(block_bytes)) if block_bytes else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_of(col: Column) -> Column:
    """crc32 of a value's text (long); null for null."""
    return F.crc32(col.cast("string").cast("binary"))


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts (null as empty) of record batches with two columns."""
    for b in batches:
        yield b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]


def key_field(df: DataFrame, key: str):
    """The Spark type name of a key column, for output schemas."""
    return df.schema[key].dataType.simpleString()
