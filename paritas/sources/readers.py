"""Readers chosen by file suffix, and schema listings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Fixed value: the name callers catch.
class MissingDependencyError(Exception):
    pass


#: Types a CSV column may get, narrowest first, with the texts they take. Dates stay text.
CSV_TYPES = [
    ("int", r"[+-]?[0-9]{1,10}"),
    ("bigint", r"[+-]?[0-9]{1,19}"),
    ("double", r"(?i)[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|nan|[+-]?inf(inity)?"),
    ("boolean", r"(?i)true|false"),
]


def infer_types(raw: DataFrame) -> dict[str, str]:
    """The type of each text column, from one pass over all of them: the
    narrowest that every value takes (missing: null or blank), text if none
    does or no value is there."""
    checks = []
    for i, c in enumerate(raw.columns):
        text = F.nullif(F.btrim(F.col(f"`{c}`")), F.lit(""))
        checks.append(F.count(text).alias(f"{i} string"))
        for kind, shape in CSV_TYPES:
            fits = text.rlike(f"^(?:{shape})$") & text.try_cast(kind).isNotNull()
            checks.append(F.count_if(fits).alias(f"{i} {kind}"))
    n = raw.agg(*checks).first().asDict() if checks else {}
    return {c: next((kind for kind, _ in CSV_TYPES if 0 < n[f"{i} string"] == n[f"{i} {kind}"]), "string")
            for i, c in enumerate(raw.columns)}


def _csv(spark: SparkSession, path: str, schema, multi_line: bool) -> DataFrame:
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if schema is not None:
        return r.schema(schema).csv(path)
    raw = r.csv(path)
    types = infer_types(raw)
    typed = lambda c: F.col(f"`{c}`") if types[c] == "string" else F.btrim(F.col(f"`{c}`")).try_cast(types[c])
    return raw.select(*[typed(c).alias(c) for c in raw.columns])


def _no_decoder(*_) -> DataFrame:
    raise MissingDependencyError("a SAS data set cannot be decoded here; export it as CSV/Parquet first")


#: Readers by file suffix.
READERS = {
    "csv": _csv,
    "parquet": lambda spark, path, schema, _: (spark.read.schema(schema) if schema is not None else spark.read).parquet(path),
    "sas7bdat": _no_decoder,
}


def read_source(spark: SparkSession, path: str, schema=None, multi_line: bool = False) -> DataFrame:
    """Read a source by its case-insensitive suffix. CSV has a header row,
    quotes are doubled inside quotes, and types are inferred unless ``schema``
    is given (one aggregation, run at once, see ``infer_types``); line breaks
    inside quotes need ``multi_line``, which makes each file one task."""
    suffix = path.lower().rstrip("/").rpartition(".")[2]
    if suffix not in READERS:
        raise ValueError(f"unsupported source format: {path}")  # fixed value: the text callers look for
    return READERS[suffix](spark, path, schema, multi_line)


def table_schemas(spark: SparkSession, tables: list[str]) -> DataFrame:
    """``(table_name, schema)`` with ``schema`` as ``"col type, ..."``; tables
    that do not exist are skipped."""
    rows = []
    for t in tables:
        try:
            fields = spark.table(t).schema.fields
        except AnalysisException as e:
            if "TABLE_OR_VIEW_NOT_FOUND" not in str(e):
                raise
            continue
        rows.append((t, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)))
    return spark.createDataFrame(rows, "table_name string, schema string")


def frame_schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def with_source_file(df: DataFrame) -> DataFrame:
    """Add the file each row came from (lineage for landed data)."""
    return df.withColumn("_source_file", F.input_file_name())
