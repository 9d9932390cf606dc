"""A training corpus in five stages: toxic documents go, one document of each
group of near copies stays, personal data is replaced, sources are mixed to
their target weights, and texts become sampled pieces.

Each stage takes ``(spark, docs, sf_dir)``. All but the last return the columns
of ``documents``; ``docs`` is what the stage before has kept, as written. Null
and empty texts pass through every stage that does not have to choose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.llm import common as C
from paritas.llm import jaccard, mixing, pieces, pii, toxicity
from paritas.llm.settings import source_levels, source_weights, tokenizer_file

#: The mixture takes this share of the tokens that reach it, each document once at most.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.9, 1, 7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; learned outside the held-out third."""
    C.prepare(spark)
    model = toxicity.fitted(docs, C.table(spark, sf_dir, "labels"), C.crc_of(F.col("row_key")) % 3 != 1)
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    C.prepare(spark)
    return jaccard.one_per_class(docs, jaccard.join(docs)).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows."""
    C.prepare(spark)
    return pii.redacted(docs, pii.train()).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken by the budgets of domains, languages and sources."""
    C.prepare(spark)
    taken = mixing.mix(docs, source_levels(), source_weights(spark), MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return mixing.mixed(docs, taken).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every remaining text."""
    C.prepare(spark)
    return pieces.encoded(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("source_mixture", mix_sources),
    ("pieces", encode_pieces),
]

#: Training and sampling cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next one reads it."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
