"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model scores each sentence from
its words and their beginnings of four and five letters; the document's score is the
noisy-or of its sentences, ``1 - prod(1 - p)``. Only documents carry labels,
and the gradient of the document likelihood flows back to the sentences that
explain it, so the trained model also tells which sentences offend.

The model is fitted on a bounded sample of labelled rows (``Fit`` holds the
bounds); every document is scored over its whole text.

Defined results: null and empty texts have no sentence and score 0; rows with
a null label or no label are never learned from; repeated labels of a document
count once (the larger); no label at all of a class gives a model that scores
every document near 0; repeated rows are scored one by one; other columns are
neither read nor returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_RE = re.compile(r"[^.!?\n]+")
WORD_RE = re.compile(r"[^\W\d_]+")
STEMS = (4, 5)
THRESHOLD = 0.7


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of the training. At most ``per_class`` documents of
    either label, of at most ``max_chars`` characters, reach the driver; the
    weights cover at most ``max_features`` features, those whose document
    frequencies differ between the classes by ``min_strength`` standard errors."""
    per_class: int = 2500
    max_chars: int = 20_000
    max_features: int = 20_000
    min_docs: int = 3
    min_strength: float = 2.5
    steps: int = 300
    rate: float = 0.4
    l2: float = 1e-5
    start: float = -9.0
    seed: int = 17


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]


def features(word: str) -> tuple[str, ...]:
    return word, *("^" + word[:n] for n in STEMS if len(word) > n)


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and distinct lower-cased words of each sentence with words."""
    for m in SENTENCE_RE.finditer(text):
        words = set(WORD_RE.findall(m.group().lower()))
        if words:
            yield m.start(), m.end(), words


def training_rows(df: DataFrame, labels: DataFrame, allowed: Column, fit: Fit,
                  key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """A bounded sample ``(text, label)`` of allowed labelled documents, taken
    in the order of a seeded hash of the key, per class; of documents with the
    same key, the smallest text."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("row_key")) \
        .agg(F.max(label).cast("int").alias("row_label"))
    rows = df.select(F.col(key).alias("row_key"), F.col(text).alias("row_text")) \
        .where(allowed & F.col("row_text").isNotNull() & (F.length("row_text") <= fit.max_chars))
    # Keys first, without their texts; the chosen ones are few, whatever the input.
    keys = known.join(rows.select("row_key").distinct(), "row_key")
    order = [F.xxhash64(F.lit(fit.seed), F.col("row_key")), "row_key"]
    part = lambda y: keys.where(F.col("row_label") == y).orderBy(*order).limit(fit.per_class)
    chosen = part(0).unionAll(part(1))
    return rows.join(F.broadcast(chosen), "row_key").groupBy("row_key", "row_label") \
        .agg(F.min("row_text").alias("row_text")).select("row_text", "row_label")


def train(rows: list[tuple[str, int]], fit: Fit) -> Model:
    """Maximum likelihood of the document labels under noisy-or (Adam)."""
    # Words as numbers: one text object per distinct word, flat arrays else.
    numbers: dict[str, int] = {}
    words, sent_sizes, doc_sents, label = array("i"), array("i"), array("i"), []
    for text, toxic in rows:
        before = len(sent_sizes)
        for _, _, found in sentences(text):
            words.extend([numbers.setdefault(w, len(numbers)) for w in sorted(found)])
            sent_sizes.append(len(found))
        if len(sent_sizes) > before:
            doc_sents.append(len(sent_sizes) - before)
            label.append(toxic)
    n_pos = sum(label)
    n_neg = len(label) - n_pos
    if not n_pos or not n_neg:
        return Model(fit.start, {})
    index: dict[str, int] = {}
    of_word = np.full((len(numbers), 1 + len(STEMS)), -1, dtype=np.int32)
    for w, i in numbers.items():
        for k, f in enumerate(features(w)):
            of_word[i, k] = index.setdefault(f, len(index))
    del numbers
    word = np.frombuffer(words, dtype=np.int32)
    doc = np.repeat(np.arange(len(label)), doc_sents)
    sent = np.repeat(np.arange(len(sent_sizes)), sent_sizes)
    seen = np.zeros((2, len(index)))
    edge = np.concatenate([[0], np.cumsum(np.bincount(doc[sent], minlength=len(label)))])
    for d, toxic in enumerate(label):
        have = np.unique(of_word[word[edge[d]:edge[d + 1]]])
        seen[toxic, have[have >= 0]] += 1
    # Keep the features whose document frequency differs most between classes.
    p = seen.sum(axis=0) / len(label)
    strength = np.abs(seen[1] / n_pos - seen[0] / n_neg) / np.sqrt(p * (1 - p) * (1 / n_pos + 1 / n_neg) + 1e-9)
    strength[seen.sum(axis=0) < fit.min_docs] = 0
    order = np.lexsort((np.arange(len(index)), -strength))[:fit.max_features]
    chosen = order[strength[order] >= fit.min_strength]
    place = np.full(len(index) + 1, -1, dtype=np.int64)  # the last one stands for no feature
    place[chosen] = np.arange(len(chosen))
    names = list(index)
    kept = [names[i] for i in chosen]
    del index, names
    feat = place[of_word[word]].ravel()
    sent = np.repeat(sent, of_word.shape[1])[feat >= 0]
    feat = feat[feat >= 0]
    y = np.array(label, dtype=float)
    # Both classes weigh as in the sample's own rate, so scores stay calibrated
    # to the rarer class rather than to the sampling.
    w, bias = np.zeros(len(kept) + 1), fit.start
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, fit.steps + 1):
        z = np.bincount(sent, weights=w[feat], minlength=len(doc)) + w[-1]
        area = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(y))
        d_area = (1 - y) - y * np.exp(-area) / np.maximum(-np.expm1(-area), 1e-12)
        d_z = d_area[doc] / (1 + np.exp(-z))
        g = np.zeros_like(w)
        g[:-1] = np.bincount(feat, weights=d_z[sent], minlength=len(kept)) / len(y) + fit.l2 * w[:-1]
        g[-1] = d_z.sum() / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= fit.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Model(float(w[-1]), {f: float(x) for f, x in zip(kept, w[:-1], strict=True) if abs(x) > 1e-3})


def fitted(df: DataFrame, labels: DataFrame, allowed: Column, fit: Fit = Fit(), **names: str) -> Model:
    """Train on the bounded sample of ``training_rows`` (collected)."""
    rows = training_rows(df, labels, allowed, fit, **names).collect()
    return train([(r[0], r[1]) for r in rows], fit)


class Scorer:
    """Scores texts; keeps the weight of each word it has met, within a bound."""

    MOST_WORDS = 150_000

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def weight(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.MOST_WORDS:
                self.known.clear()
            got = self.known[word] = sum(self.model.weights.get(f, 0.0) for f in features(word))
        return got

    def score(self, text: str, report: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or score and the sentences of probability ``report`` or more."""
        area, found, weight, bias = 0.0, [], self.weight, self.model.bias
        for start, end, words in sentences(text):
            z = bias + sum(map(weight, words))
            area += math.log1p(math.exp(z)) if z < 30 else z
            if z > -20:
                p = 1 / (1 + math.exp(-z))
                if p >= report:
                    found.append((start, end, p))
        return -math.expm1(-area), found


def scored(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text",
           report: float = 0.5) -> DataFrame:
    """``key``, ``score`` (0 to 1) and ``offending``: start, end (code points,
    end exclusive) and probability of the offending sentences."""
    kind = df.schema[key].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            got = [scorer.score(t or "", report) for t in b.column(1).to_pylist()]
            spans = [[{"start": s, "end": e, "p": p} for s, e, p in f] for _, f in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array(spans, pa.list_(span))],
                ["row_key", "score", "offending"])

    out = df.select(F.col(key).alias("row_key"), F.col(text).alias("row_text")).mapInArrow(
        run, f"row_key {kind}, score double, offending array<struct<start:bigint,end:bigint,p:double>>")
    return out.withColumnRenamed("row_key", key)


def without_toxic(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, whose text scores below ``threshold``."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            yield b.filter(pa.array([scorer.score(t or "")[0] < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold).cast("int")
