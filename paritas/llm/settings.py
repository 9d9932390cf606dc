"""Production parameters that queries and pipeline share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the public tokenizers' vocabulary files; None: where the installed
#: package has them.
TOKENIZERS: str | None = None
#: The id that ends a document in token files.
END_ID = 2

#: Target weights of the mixture: four domains (of the source's number), the
#: languages within each, and equal weights for the sources of a language.
DOMAIN_WEIGHTS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}
LANGUAGE_WEIGHTS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file on every machine."""
    if TOKENIZERS:
        return f"{TOKENIZERS.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def source_levels() -> dict[str, Column]:
    """Domain, language and source of a document; a source without a number
    is in the first domain."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS BIGINT)"), F.lit(0))
    return {"domain": F.concat(F.lit("d"), (number % 4).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def source_weights(spark: SparkSession) -> DataFrame:
    rows = [(d, w) for d, w in DOMAIN_WEIGHTS.items()]
    rows += [(f"{d}/{x}", w) for d in DOMAIN_WEIGHTS for x, w in LANGUAGE_WEIGHTS.items()]
    return spark.createDataFrame(rows, "path string, weight double")
