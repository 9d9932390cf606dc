"""Landing normalization: a whole table as SAS would hand it over.

Date columns (SAS day numbers) become ISO date text; every other column gets
the missing-value rules of :func:`paritas.functions.sas.normalize_value`.
One ``select`` generated from the schema: narrow, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.functions.sas import normalize_value, sas_date_to_iso


def normalize_frame(df: DataFrame, date_cols: list[str] | None = None) -> DataFrame:
    dates = {c.lower() for c in (date_cols or [])}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name.lower() in dates:
            out.append(sas_date_to_iso(c).alias(f.name))
        else:
            out.append(normalize_value(c, f.dataType).alias(f.name))
    return df.select(*out)


def count_out_of_range_dates(df: DataFrame, date_cols: list[str]) -> DataFrame:
    """Per date column, how many non-missing day numbers gave no date."""
    aggs = []
    for c in date_cols:
        raw = F.col(f"`{c}`").try_cast("double")
        aggs.append(F.count_if(raw.isNotNull() & ~F.isnan(raw)
                               & sas_date_to_iso(F.col(f"`{c}`")).isNull()).alias(c))
    return df.agg(*aggs)
