"""The registered queries of this subpackage, one per operator, plus the
pipeline. Each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from paritas.llm import common as C
from paritas.llm import collocations, jaccard, merkle, mixing, pieces, pii, pitman_yor, quotes, rules, token_counts, token_store, topk, toxicity
from paritas.llm.settings import END_ID, source_levels, source_weights, tokenizer_file

#: Documents with more tokens are over the limit.
TOKEN_LIMIT = 1024
#: Collocations reported per language.
BEST_PHRASES = 2000
#: What a leaf of the manifest covers, in this order.
MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(C.prepare(spark), sf_dir)
        prepared.__doc__ = fn.__doc__
        REGISTRY[name] = prepared
        return fn
    return deco


@register("op1_source_mixture")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture over all documents: every taken document and epoch, for a
    budget of 1.2 times the tokens and up to four epochs."""
    taken = mixing.mix(C.table(spark, sf_dir, "documents"), source_levels(), source_weights(spark), 1.2, 4, 7)
    return taken.withColumnRenamed("row_key", "doc_id").drop("row_hash")


@register("op3_quotation_threads")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of all conversations, whose turns are first written as mail that
    quotes the two turns before; linked by what they quote alone."""
    mail = quotes.quoting_mail(C.table(spark, sf_dir, "conversations"))
    return quotes.conversations(mail).withColumn("own_text", F.md5(F.coalesce("own_text", F.lit(""))))


@register("op2_rule_ledger")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of every document, with the verdict of the newest policy."""
    rows = rules.ledger(C.table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
        (~rules.passes("base")).alias("base_failed"),
        (rules.passes("base") & rules.passes("v2")).alias("kept"))


@register("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or toxicity of every document and its offending sentences; learned
    from documents outside the held-out third only."""
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    model = toxicity.fitted(docs, labels, C.crc_of(F.col("row_key")) % 3 != 1)
    return toxicity.scored(docs, model).select(
        "doc_id", (C.crc_of(F.col("doc_id")) % 3 == 1).alias("held_out"), "score",
        toxicity.predicted(F.col("score")).alias("predicted"),
        F.size("offending").alias("n_offending"),
        F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("offending"))


@register("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: pattern spans and the field's own."""
    return pii.detected(C.table(spark, sf_dir, "documents"), pii.train()).drop("redacted")


@register("op9_sampled_pieces")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, and that it decodes to the text."""
    return pieces.encoded(C.table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@register("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as written to shards in key order and read back."""
    path = C.scratch(spark, "token-files")
    token_store.write(C.table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), END_ID)
    return token_store.directory(spark, path).select(
        F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


@register("op8_pivot_top_k")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector against all."""
    return topk.top_k(C.table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0).drop("query_hash")


@register("op7_ngram_jaccard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document (five words, 0.8)."""
    return jaccard.join(C.table(spark, sf_dir, "documents")).drop("row_hash", "component").withColumnRenamed("row_key", "doc_id")


@register("op6_pitman_yor")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; learned from six sevenths of them."""
    docs = C.table(spark, sf_dir, "documents")
    x = pitman_yor.scored(docs, C.crc_of(F.col("doc_id")) % 7 != 2)
    return x.select(F.col("row_key").alias("doc_id"), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known",
                    "train_tokens", "base_score", "score")


@register("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 1,024 tokens."""
    counts = token_counts.counted(C.table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@register("op12_merkle_manifest")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that its
    leaf folds to, where every third row's text has been tampered with."""
    tampered = F.when(C.crc_of(F.col("doc_id")) % 3 == 0, merkle.leaf(
        *[merkle.ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in MANIFEST_FIELDS]))
    x = merkle.manifest(C.table(spark, sf_dir, "documents"), MANIFEST_FIELDS, keep={"tampered": tampered}).proofs()
    start = F.coalesce("keep_tampered", "leaf")
    return x.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root",
                    merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                    merkle.folded(start, F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


@register("op13_collocations")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of two or three words of each language."""
    found = collocations.phrases(C.table(spark, sf_dir, "documents"))
    return collocations.collocations(found, BEST_PHRASES).withColumnRenamed("g", "lang")


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline`` over the documents."""
    return corpus_pipeline.run(spark, sf_dir)
