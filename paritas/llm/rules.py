"""Quality rules as a bitmask ledger.

``ledger`` reads every text once and stores its measurements and one integer
whose bit *i* says that rule *i* failed. Policies are versioned sets of rules,
that is bit masks: applying another version, or asking what a rule alone
costs, needs only the ledger (bitwise operations), never the texts again.

Defined results: a null text counts as empty (all measurements 0, which fails
``too_few_words``); an empty text likewise; every input row gives one row,
repeated rows and repeated keys included; other columns of the input are
neither read nor returned, whatever their names; an empty table gives an empty
ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_bytes", "n_upper", "n_letters", "n_exclaims")

#: Rules in bit order: a condition over the measurements that means failure.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "shouting": "10 * n_upper > 3 * n_letters",
    "exclaiming": "10 * n_exclaims > n_words",
    "word_length": "word_chars > 12 * n_words OR word_chars < 2 * n_words",
    "few_letters": "10 * n_letters < 4 * n_bytes",
}

#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "many_symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}


def rule_bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def policy_mask(version: str) -> int:
    return sum(rule_bit(r) for r in POLICIES[version])


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    v = len(ids)
    if v == n:
        return 0
    a = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=n)
    pair = a[:-2] * v + a[1:-1]
    if v >= 1 << 20:  # three ids would not fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair * v + a[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    mark = np.zeros(n, dtype=bool)
    for k in range(3):
        mark[k:n - 2 + k] |= hit
    return int(mark.sum())


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    blanks = len(raw) - sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    codes = np.frombuffer(raw, dtype=np.uint8)
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    lower = int(((codes >= 97) & (codes <= 122)).sum())
    return (len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines),
            len(lines) - len(set(lines)), repeated_words(words), len(raw), upper,
            upper + lower + int((codes >= 128).sum()), raw.count(b"!"))


def measurements(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the measurements of every row's whole text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t or "") for t in b.column(1).to_pylist()]
            cols = zip(*rows, strict=True) if rows else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["row_key", *MEASURES])

    schema = f"row_key {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    return df.select(F.col(key).alias("row_key"), F.col(text).alias("row_text")) \
        .mapInArrow(run, schema).withColumnRenamed("row_key", key)


def failure_bits() -> Column:
    """One long: bit i set where rule i fails."""
    return sum((F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
                for i, cond in enumerate(RULES.values())), F.lit(0).cast("long"))


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every rule evaluated once: key, measurements and ``fail_bits``."""
    return measurements(df, key, text).withColumn("fail_bits", failure_bits())


def passes(version: str, bits: Column | None = None) -> Column:
    """True where a ledger row passes the policy of this version."""
    bits = F.col("fail_bits") if bits is None else bits
    return bits.bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0


def ablation(rows: DataFrame, versions: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """Per policy version and rule: documents, failures of the rule, those that
    only this rule rejects, and documents kept without the rule.

    The ledger is first counted by its bits (at most 2**rules groups), so the
    rest works on a table whose size does not depend on the documents."""
    counts = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"),
                               F.lit(rule_bit(r)).cast("long").alias("bit"),
                               F.lit(policy_mask(v)).cast("long").alias("mask"))
                      for v in versions for r in POLICIES[v]])
    x = counts.select("fail_bits", "n", F.explode(pairs).alias("p")).select("fail_bits", "n", "p.*")
    inside = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    return x.groupBy("version", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(inside == F.col("bit")).alias("n_only"),
        total((inside == 0) | (inside == F.col("bit"))).alias("n_kept_without"))
