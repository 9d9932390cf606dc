"""Hierarchical Pitman-Yor language model over all documents.

Restaurants: one per word before (the whole word; a text starts after an end
token), all with the same parent, the restaurant without context, whose base
is uniform over the known words and one place for unknown ones. A context
restaurant sends one customer to the parent per table. Seating is sampled by
Gibbs sweeps over the table counts. A dish of up to ``EXACT`` customers is emptied and its
number of tables drawn from the exact conditional, given the tables of the
restaurant's other dishes and the parent's probability: proportional to the
generalised Stirling number (ways to seat the customers at so many tables),
the odds of opening these tables, and the parent's probability to that power.
A dish of more customers is seated anew going forward (the first ``ONE_BY_ONE``
singly, later ones in blocks of a sixteenth of those seated), a proposal without
correction. Totals of other dishes are those before the sweep. Each dish draws
from numbers of its own (a hash of seed, sweep, word and context), so scores do
not depend on slices or partitions. The probability of a word is the average
over the sampled seatings.

How it is spread: a batch of documents becomes one row with its word numbers.
Slices of the vocabulary (ranges of word hashes) count the learned words and
give each an id, the smaller the more frequent, so that contexts and words
travel in few bytes. A batch then asks, per slice of the words, about its pairs
of word and context, each once. A slice collects the counts of its words from all
batches, holds all contexts of a word side by side, and is seated in parallel.
A context's dishes lie in many slices: per sweep each slice sends the tables of
its contexts to the contexts' homes, which add them up and send the totals back
to the slices that hold the context. The driver sees a few sums only. The answers go
back to the batches, which sum them per document. So what is shuffled is one
entry per distinct word, context and batch, not one per token, and per sweep one
per context and slice.

Defined results: null and empty texts are the end token alone; with no
training document every word is unknown and the model is its base; an unknown
word makes an empty restaurant, which passes on to the parent; repeated
rows count and are scored one by one; a null key is held out or not as the
caller's condition says; other columns are neither read nor returned; an empty
table gives an empty result. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import scratch, written
from paritas.llm.pieces import mix, unit

BATCH_TOKENS = 2_000_000
#: Tokens a slice of the words gets on average, where the caller names no number of slices.
SLICE_TOKENS = 8_000_000
#: Ranges of word hashes (a power of two) within which words are ranked by their counts.
RANGES = 1024
ONE_BY_ONE = 64
#: Customers up to which a dish's tables are drawn from the exact conditional.
EXACT = 64
END = np.uint64(0x5BD1E9955BD1E995)


@dataclass(frozen=True)
class Sampling:
    """Sweeps of the sampler, how many of the last ones are averaged, the
    strengths of the context restaurants and the parent, and the seed."""
    sweeps: int = 4
    averaged: int = 3
    strength: float = 1.0
    top_strength: float = 1.0
    seed: int = 11


# ---------------------------------------------------------------- numbers as bytes


def spelled(values: np.ndarray) -> bytes:
    """Small numbers in one byte each where they fit, else in eight."""
    wide = values >= 255
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[wide].astype("<i8").tobytes()


def unspelled(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, dtype=np.uint8, count=n).astype(np.int64)
    wide = out == 255
    out[wide] = np.frombuffer(raw, dtype="<i8", offset=n)
    return out


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, as planes of bytes of like weight, compressed."""
    head, parts = [len(arrays)], []
    for a in arrays:
        v = np.ascontiguousarray(a, dtype="<u8")
        width = (int(v.max()).bit_length() + 7) // 8 if len(v) else 0
        head += [len(v), width]
        parts.append(v.view(np.uint8).reshape(-1, 8).T[:width].tobytes())
    raw = b"".join(parts)
    return np.array([*head, len(raw)], dtype="<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(body: bytes) -> list[np.ndarray]:
    k = int.from_bytes(body[:8], "little")
    head = np.frombuffer(body, dtype="<i8", count=2 * k + 1, offset=8)
    raw, at, out = pa.decompress(body[16 + 16 * k:], int(head[-1]), codec="zstd", asbytes=True), 0, []
    for n, width in head[:-1].reshape(-1, 2).tolist():
        v = np.zeros((n, 8), dtype=np.uint8)
        v[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T
        out.append(v.view("<u8").reshape(-1))
        at += n * width
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Ascending numbers as the steps between them."""
    return np.diff(ascending.astype(np.uint64), prepend=np.uint64(0))


def climbed(v: np.ndarray) -> np.ndarray:
    return np.cumsum(v, dtype=np.uint64)


# ---------------------------------------------------------------- batches


class _Numbers(dict):
    """Numbers of the words of a batch, in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def word_slice(hashes: np.ndarray, slices: int) -> np.ndarray:
    """The slice of the vocabulary that has a word: whole ranges of hashes, ascending."""
    return (hashes // np.uint64(2 ** 64 // RANGES)).astype(np.int64) * slices // RANGES


def home(ids: np.ndarray, slices: int) -> np.ndarray:
    """The slice of a word with its contexts, and the place that adds up a context."""
    return (mix(ids.astype(np.uint64)) % np.uint64(slices)).astype(np.int64)


def batch_row(name: str, keys: list, learn: list[bool], texts: list[np.ndarray], numbers: dict, slices: int) -> dict:
    """One batch: its documents, their tokens as numbers of words in the order
    of the words' hashes, and per slice of the vocabulary these hashes with the
    learned counts."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    word, n = np.concatenate(texts), len(numbers)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), dtype=np.uint64, count=n)
    hashes[0] = END  # number 0 is the end token
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    weight = np.repeat(np.array(learn, dtype=np.float64), size)
    total, hashes = np.bincount(word, weights=weight, minlength=n).astype(np.int64)[order], hashes[order]
    edge = np.searchsorted(word_slice(hashes, slices), np.arange(slices + 1))
    words = [{"slice": i, "body": packed(steps(hashes[a:b]), total[a:b])} for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
    return {"batch": name, "keys": keys, "learn": learn, "sizes": size.tolist(), "tokens": packed(rank[word], rank[:1]), "words": words}


def batches(df: DataFrame, learn: Column, slices: int, key: str, text: str) -> DataFrame:
    """All documents as batch rows of about ``BATCH_TOKENS`` tokens."""
    kind, at_most = df.schema[key].dataType.simpleString(), BATCH_TOKENS

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, flags, texts, numbers, held, schema = [], [], [], _Numbers({b"": 0}), 0, None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([batch_row(uuid.uuid4().hex, keys, flags, texts, numbers, slices)], schema)

        for b in rows:
            schema = schema or pa.schema([
                ("batch", pa.string()), ("keys", pa.list_(b.schema.field(0).type)), ("learn", pa.list_(pa.bool_())),
                ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()),
                ("words", pa.list_(pa.struct([("slice", pa.int32()), ("body", pa.binary())])))])
            for k, flag, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").lower().split()
                ids = np.zeros(len(words) + 1, dtype=np.int32)
                ids[:-1] = np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words))
                keys.append(k)
                flags.append(bool(flag))
                texts.append(ids)
                held += len(ids)
                if held >= at_most:
                    yield flush()
                    keys, flags, texts, numbers, held = [], [], [], _Numbers({b"": 0}), 0
        if keys:
            yield flush()

    rows = df.select(F.col(key).alias("row_key"), F.coalesce(learn, F.lit(False)).alias("row_learn"), F.col(text).alias("row_text"))
    return rows.mapInArrow(run, f"batch string, keys array<{kind}>, learn array<boolean>, sizes array<bigint>, tokens binary, "
                                "words array<struct<slice:int,body:binary>>")


def bucketed(df: DataFrame, by: str, parts: int) -> DataFrame:
    """``df`` written to the shared folder in buckets, so that a later grouping
    by the same column reads it where it lies, without another shuffle."""
    spark = df.sparkSession
    name = f"paritas_{uuid.uuid4().hex}"
    df.write.option("path", scratch(spark, "batches")).option("compression", "zstd").option("parquet.block.size", str(8 << 20)) \
        .bucketBy(parts, by).saveAsTable(name)
    read = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, the catalog does not fill up
    return read


# ---------------------------------------------------------------- vocabulary


PLACED = pa.schema([("batch", pa.string()), ("slice", pa.int32()), ("body", pa.binary())])
PLACED_DDL = "batch string, slice int, body binary"


def vocabulary(held: DataFrame) -> DataFrame:
    """``batch``, ``slice`` and, for the words that the batch named there, their
    ids (0: never learned) and learned counts. An id is the word's rank by count
    within its range of hashes, times the ranges, plus the range, from 1 on: it
    depends on the words and counts alone, not on slices."""

    def run(t: pa.Table) -> pa.Table:
        asked = [unpacked(x) for x in t.column("body").to_pylist()]
        words = [climbed(x[0]) for x in asked]
        word, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([x[1] for x in asked]), minlength=len(word)).astype(np.int64)
        span = (word // np.uint64(2 ** 64 // RANGES)).astype(np.int64)
        order = np.lexsort((word, -total, span))
        rank = np.empty(len(word), dtype=np.int64)
        rank[order] = np.arange(len(word)) - np.searchsorted(span, span[order])
        ids = np.where(total > 0, 1 + rank * RANGES + span, 0)
        edge = np.cumsum([0, *map(len, words)])
        bodies = [packed(ids[at[a:b]], total[at[a:b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.Table.from_arrays([t.column("batch"), t.column("slice"), pa.array(bodies, pa.binary())], schema=PLACED)

    words = held.select("batch", F.explode("words").alias("w")).select("batch", "w.slice", "w.body")
    return words.groupBy("slice").applyInArrow(run, PLACED_DDL)


def word_ids(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and learned counts of a batch's words, by their number in the batch."""
    got = [unpacked(x) for x in replies.sort_by("slice").column("body").to_pylist()]
    return tuple(np.concatenate([x[i] for x in got]).astype(np.int64) for i in (0, 1))


def batch_pairs(row: dict, ids: np.ndarray, slices: int) -> tuple[np.ndarray, ...]:
    """The distinct pairs of a batch by slice, word and context: slice, word id,
    context id and learned count, and per token the number of its pair. Pairs with an
    unknown word lie with their context."""
    token, end = (x.astype(np.int64) for x in unpacked(row["tokens"]))
    size = np.array(row["sizes"], dtype=np.int64)
    known, number = np.unique(ids, return_inverse=True)
    word = number[token]
    ctx = np.empty_like(word)
    ctx[1:] = word[:-1]
    ctx[np.concatenate([[0], np.cumsum(size)[:-1]])] = number[end[0]]  # a text starts after an end
    pair, pid = np.unique(word * len(known) + ctx, return_inverse=True)
    count = np.bincount(pid, weights=np.repeat(np.array(row["learn"], dtype=np.float64), size), minlength=len(pair)).astype(np.int64)
    w, u = known[pair // len(known)], known[pair % len(known)]
    there = home(np.where(w > 0, w, u), slices)
    order = np.argsort(there, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return there[order], w[order], u[order], count[order], place[pid]


def requests(held: DataFrame, vocab: DataFrame, slices: int) -> DataFrame:
    """``batch``, ``slice`` and the batch's pairs there: words ascending, contexts
    per word, the contexts and the learned counts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, (ids, _) = [], word_ids(right)
        for row in left.to_pylist():
            there, w, u, count, _ = batch_pairs(row, ids, slices)
            edge = np.searchsorted(there, np.arange(slices + 1))
            for i in np.flatnonzero(np.diff(edge)).tolist():
                a, b = edge[i], edge[i + 1]
                word, per = np.unique(w[a:b], return_counts=True)
                out.append({"batch": row["batch"], "slice": i, "body": packed(steps(word), per, u[a:b], count[a:b])})
        return pa.Table.from_pylist(out, PLACED)

    return held.select("batch", "learn", "sizes", "tokens").groupBy("batch").cogroup(vocab.groupBy("batch")).applyInArrow(run, PLACED_DDL)


# ---------------------------------------------------------------- slices


def slice_rows(asked: DataFrame) -> DataFrame:
    """One row per slice: its learned counts (``known``), all contexts that are
    asked about there, and the requests (``batches``, ``bodies``) that will be
    answered from them."""
    fields = pa.schema([("slice", pa.int32()), ("known", pa.binary()), ("contexts", pa.binary()), ("batches", pa.list_(pa.string())),
                        ("bodies", pa.list_(pa.binary()))])

    def run(t: pa.Table) -> pa.Table:
        words, ctxs, counts = [], [], []
        for raw in t.column("body").to_pylist():
            w, per, ctx, n = unpacked(raw)
            words.append(np.repeat(climbed(w), per.astype(np.int64)))
            ctxs.append(ctx)
            counts.append(n)
        contexts, ctx = np.unique(np.concatenate(ctxs), return_inverse=True)
        count = np.concatenate(counts).astype(np.int64)
        live = count > 0
        word, at = np.unique(np.concatenate(words)[live], return_inverse=True)
        pair, same = np.unique(at * len(contexts) + ctx[live], return_inverse=True)
        n = np.bincount(same, weights=count[live], minlength=len(pair)).astype(np.int64)
        per = np.bincount(pair // len(contexts), minlength=len(word))
        return pa.Table.from_pylist([{"slice": t.column("slice")[0].as_py(), "known": packed(steps(word), per, pair % len(contexts), n),
                                      "contexts": packed(steps(contexts)), "batches": t.column("batch").to_pylist(),
                                      "bodies": t.column("body").to_pylist()}], fields)

    return asked.groupBy("slice").applyInArrow(run, "slice int, known binary, contexts binary, batches array<string>, bodies array<binary>")


def first_seating(known: bytes, contexts: bytes) -> dict[str, np.ndarray]:
    """A slice's restaurants with one table per dish. ``pair_context`` numbers ``contexts``."""
    word, per, ctx, n = unpacked(known)
    n = n.astype(np.int64)
    return {"words": climbed(word), "pair_word": np.repeat(np.arange(len(word)), per.astype(np.int64)), "contexts": climbed(unpacked(contexts)[0]),
            "pair_context": ctx.astype(np.int64), "counts": n, "tables": np.minimum(n, 1), "top_tables": np.ones(len(word), dtype=np.int64)}


def parent_customers(x: dict[str, np.ndarray]) -> np.ndarray:
    """Customers of each dish at the parent: the tables of all contexts."""
    return np.bincount(x["pair_word"], weights=x["tables"], minlength=len(x["words"])).astype(np.int64)


@dataclass(frozen=True)
class Totals:
    """Totals over all slices: a bounded number of numbers."""
    words: int
    tokens: int
    discount: float
    top_discount: float
    customers: np.ndarray
    tables: np.ndarray
    top_customers: int
    top_tables: int


def discount(ones: int, twos: int) -> float:
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones + twos else 0.5


SUMS = ("n_words", "n_tokens", "ones", "twos", "top_ones", "top_twos", "top_customers", "top_count")
#: A sweep's rows: the state of a slice (``home`` null, with its sums), or what it sends to a home of contexts.
SWEEP = pa.schema([("sweep", pa.int32()), ("slice", pa.int32()), ("home", pa.int32()), ("body", pa.binary()), *((c, pa.int64()) for c in SUMS)])
SWEEP_DDL = "sweep int, slice int, home int, body binary, " + ", ".join(f"{c} bigint" for c in SUMS)
REPLY = pa.schema([("sweep", pa.int32()), ("slice", pa.int32()), ("home", pa.int32()), ("body", pa.binary())])
REPLY_DDL = "sweep int, slice int, home int, body binary"


def slice_sums(x: dict[str, np.ndarray]) -> dict[str, int]:
    """What a slice adds to the totals."""
    top = parent_customers(x)
    numbers = (len(x["words"]), x["counts"].sum(), (x["counts"] == 1).sum(), (x["counts"] == 2).sum(), (top == 1).sum(),
               (top == 2).sum(), top.sum(), x["top_tables"].sum())
    return {k: int(v) for k, v in zip(SUMS, numbers, strict=True)}


def sweep_rows(x: dict[str, np.ndarray], number: int, at: int, slices: int) -> pa.Table:
    """The state of a slice after ``number`` sweeps, and per home its contexts'
    tables; in the first such rows also their ids and customers."""
    here = lambda v: np.bincount(x["pair_context"], weights=v, minlength=len(x["contexts"])).astype(np.int64)
    sent = [here(x["tables"])] if number else [x["contexts"], here(x["counts"]), here(x["tables"])]
    to = home(x["contexts"], slices)
    order = np.argsort(to, kind="stable")
    edge = np.searchsorted(to[order], np.arange(slices + 1))
    rows = [{"sweep": number, "slice": at, "body": packed(x["tables"], x["top_tables"]), **slice_sums(x)}]
    for i in np.flatnonzero(np.diff(edge)).tolist():
        mine = order[edge[i]:edge[i + 1]]
        first, *rest = (v[mine] for v in sent)
        rows.append({"sweep": number, "slice": at, "home": i, "body": packed(first if number else steps(first), *rest)})
    return pa.Table.from_pylist(rows, SWEEP)


def context_totals(first: DataFrame, now: DataFrame, number: int) -> DataFrame:
    """What the homes of contexts send back to each slice: the tables of its
    contexts over all slices; after the ``first`` rows also their customers."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("sweep", "ascending"), ("slice", "ascending")])
        got = [(k, i, unpacked(raw)) for k, i, raw in zip(*(t.column(c).to_pylist() for c in ("sweep", "slice", "body")), strict=True)]
        names = [climbed(x[0]) for k, _, x in got if k == 0]
        ids, at = np.unique(np.concatenate(names), return_inverse=True)
        add = lambda parts: np.bincount(at, weights=np.concatenate(parts), minlength=len(ids)).astype(np.int64)[at]
        back = [add([x[1] for k, _, x in got if k == 0])] if number == 0 else []
        back.append(add([x[-1] for k, _, x in got if k == number]))
        edge = np.cumsum([0, *map(len, names)])
        rows = [{"sweep": number, "slice": i, "home": t.column("home")[0].as_py(), "body": packed(*(v[edge[j]:edge[j + 1]] for v in back))}
                for j, i in enumerate(i for k, i, _ in got if k == 0)]
        return pa.Table.from_pylist(rows, REPLY)

    sent = first if number == 0 else first.unionByName(now)
    return sent.where(F.col("home").isNotNull()).select("sweep", "slice", "home", "body").groupBy("home").applyInArrow(run, REPLY_DDL)


@dataclass(frozen=True)
class Past:
    """A seating: the sweep's rows, the replies of the contexts' homes, and the
    sums over all slices (``Totals`` without those of contexts)."""
    number: int
    rows: DataFrame
    replies: DataFrame
    sums: Totals

    def states(self) -> DataFrame:
        return self.rows.where(F.col("home").isNull()).select(*REPLY.names)


def seated(rows: DataFrame, before: list[Past]) -> Past:
    """The seating that a sweep's rows hold."""
    number, rows = len(before), written(rows, "sweep")
    # A block of rows per home and slice is small, so the few sums are Spark's.
    a = rows.where(F.col("home").isNull()).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS)).first()
    none = np.zeros(0, dtype=np.int64)
    sums = Totals(a[0], a[1], discount(a[2], a[3]), discount(a[4], a[5]), none, none, a[6], a[7])
    return Past(number, rows, written(context_totals(before[0].rows if before else rows, rows, number), "contexts"), sums)


def given(x: dict[str, np.ndarray], t: pa.Table, g: Totals, number: int, slices: int) -> Totals:
    """Seats ``x`` as after ``number`` sweeps, by its rows in ``t``; the totals with those of its contexts."""
    rows = [r for r in t.sort_by("home").to_pylist()]
    state = next(r["body"] for r in rows if r["home"] is None and r["sweep"] == number)
    x["tables"], x["top_tables"] = (v.astype(np.int64) for v in unpacked(state))
    order = np.argsort(home(x["contexts"], slices), kind="stable")

    def placed(sweep: int, column: int) -> np.ndarray:
        got = [unpacked(r["body"])[column] for r in rows if r["home"] is not None and r["sweep"] == sweep]
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.concatenate(got).astype(np.int64)
        return out

    return replace(g, customers=placed(0, 0), tables=placed(number, -1))


def swept(slices: DataFrame, past: list[Past], s: Sampling, count: int) -> DataFrame:
    """The rows of the next sweep."""
    last, number = past[-1].sums, past[-1].number

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for at, known, contexts in zip(*(left.column(c).to_pylist() for c in ("slice", "known", "contexts")), strict=True):
            x = first_seating(known, contexts)
            sweep(x, given(x, right, last, number, count), s, number)
            out.append(sweep_rows(x, number + 1, at, count))
        return pa.concat_tables(out)

    told = [past[-1].states(), past[-1].replies] + ([past[0].replies] if number else [])
    return slices.select("slice", "known", "contexts").groupBy("slice").cogroup(
        reduce(DataFrame.unionByName, told).groupBy("slice")).applyInArrow(run, SWEEP_DDL)


@cache
def ways(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: row c, column t, how c
    customers sit at t tables with discount d."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        out[c + 1, 1:c + 1] = out[c, 1:c + 1] + np.log(c - t * d)
        out[c + 1, 2:c + 2] = np.logaddexp(out[c + 1, 2:c + 2], out[c, 1:c + 1])
    return out


def draw_tables(c: int, other_tables: np.ndarray, prior: np.ndarray, d: float, strength: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes with ``c`` customers each, from the exact conditional;
    ``u``: a number in [0, 1) per dish."""
    t = np.arange(c)
    opened = np.cumsum(np.log(strength + d * (other_tables[:, None] + t)), axis=1)
    odds = ways(d)[c, 1:c + 1] + opened + np.log(prior)[:, None] * (t + 1)
    below = np.cumsum(np.exp(odds - odds.max(axis=1, keepdims=True)), axis=1)
    return np.minimum((below <= u[:, None] * below[:, -1:]).sum(axis=1) + 1, c)


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Binomial draws from two numbers in [0, 1) each: by the distribution
    function, by the normal one where the variance is above 100."""
    spread = n * p * (1 - p)
    out = np.clip(np.rint(n * p + np.sqrt(spread) * np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v)), 0, n).astype(np.int64)
    live = np.flatnonzero(spread <= 100)
    odd, m = p[live] > 0.5, n[live]
    q = np.where(odd, 1 - p[live], p[live])
    chance = np.exp(m * np.log1p(-q))
    below, k, x = chance.copy(), np.zeros(len(live), dtype=np.int64), 0
    while (more := (u[live] >= below) & (k == x) & (x < m)).any():
        chance = chance * np.maximum(m - x, 0) / (x + 1) * q / (1 - q)
        below += chance
        x += 1
        k[more] = x
    out[live] = np.where(odd, m - k, k)
    return out


def seat(customers: np.ndarray, other_tables: np.ndarray, prior: np.ndarray, d: float, strength: float,
         keys: np.ndarray) -> np.ndarray:
    """New table counts of dishes, each with its own random numbers (``keys``).
    ``other_tables``: the restaurant's tables of other dishes."""
    tables = np.minimum(customers, 1)
    first = unit(keys)
    order = np.argsort(customers, kind="stable")
    edge = np.searchsorted(customers[order], np.arange(EXACT + 2))
    for c in range(2, EXACT + 1):
        for at in range(edge[c], edge[c + 1], 1 + (1 << 20) // c):
            i = order[at:min(at + 1 + (1 << 20) // c, edge[c + 1])]
            tables[i] = draw_tables(c, other_tables[i], prior[i], d, strength, first[i])
    live, seated, number = np.flatnonzero(customers > EXACT), 1, 0
    while len(live):
        # A new table: odds (strength + d * tables of the restaurant) * prior against (customers of the dish seated - d * its tables).
        step = 1 if seated < ONE_BY_ONE else max(1, seated // 16)
        t, number = tables[live], number + 1
        n = np.minimum(customers[live] - seated, step)
        new = (strength + d * (other_tables[live] + t)) * prior[live]
        p = new / (new + np.maximum(seated - d * t, 1e-9))
        u, v = (unit(mix(keys[live] + np.uint64((2 * number + i) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))) for i in (0, 1))
        tables[live] = np.minimum(t + (u < p if step == 1 else binomial(n, p, u, v)), customers[live])
        seated += step
        live = live[customers[live] > seated]
    return tables


def parent_probability(top: np.ndarray, tables: np.ndarray, g: Totals, s: Sampling) -> tuple[np.ndarray, float]:
    """Of each known word at the parent, and of an unknown one."""
    base = 1.0 / (g.words + 1)
    open_ = (s.top_strength + g.top_discount * g.top_tables) / (s.top_strength + g.top_customers)
    return (top - g.top_discount * tables) / (s.top_strength + g.top_customers) + open_ * base, open_ * base


def probabilities(x: dict[str, np.ndarray], g: Totals, s: Sampling) -> np.ndarray:
    """Of each pair's word in its context, in the present seating."""
    parent, _ = parent_probability(parent_customers(x), x["top_tables"], g, s)
    u = x["pair_context"]
    below = s.strength + g.customers[u]
    return (x["counts"] - g.discount * x["tables"]) / below + (s.strength + g.discount * g.tables[u]) / below * parent[x["pair_word"]]


def sweep(x: dict[str, np.ndarray], g: Totals, s: Sampling, number: int) -> None:
    """Seat every dish of a slice anew, given the totals before the sweep."""
    words = mix(x["words"] ^ mix(np.array([(s.seed << 20) + number], dtype=np.uint64)))
    parent, _ = parent_probability(parent_customers(x), x["top_tables"], g, s)
    dishes = mix(words[x["pair_word"]] + x["contexts"][x["pair_context"]] + np.uint64(1))
    x["tables"] = seat(x["counts"], g.tables[x["pair_context"]] - x["tables"], parent[x["pair_word"]], g.discount, s.strength, dishes)
    top = parent_customers(x)
    base = np.full(len(top), 1.0 / (g.words + 1))
    x["top_tables"] = seat(top, g.top_tables - x["top_tables"], base, g.top_discount, s.top_strength, mix(words))


# ---------------------------------------------------------------- answers


def answer(raw: bytes, x: dict[str, np.ndarray], sums: np.ndarray, parents: list[np.ndarray], opens: np.ndarray,
           unknown: np.ndarray) -> bytes:
    """Log10 probabilities of a request's pairs (float32). ``sums``: of the known pairs' probabilities
    over the samples; per sample: ``parents``, the words' probabilities at the
    parent, ``unknown``, that of an unknown word, and ``opens``, the parent's
    weight in each context. A pair that was never learned has no table in any
    sample: it has the parent's share alone."""
    words, per, ctx, _ = unpacked(raw)
    words, per, ctx = climbed(words), per.astype(np.int64), np.searchsorted(x["contexts"], ctx)
    own = np.full(len(words), -1, dtype=np.int64)
    if len(x["words"]):
        at = np.minimum(np.searchsorted(x["words"], words), len(x["words"]) - 1)
        own = np.where(x["words"][at] == words, at, -1)
    there = own >= 0
    p = np.zeros(len(ctx))
    for weight, parent, none in zip(opens, parents, unknown, strict=True):
        p_word = np.full(len(words), none)
        p_word[there] = parent[own[there]]
        p += weight[ctx] * np.repeat(p_word, per)
    if there.any():
        ids = x["pair_word"] * len(x["contexts"]) + x["pair_context"]
        ask = np.repeat(own, per) * len(x["contexts"]) + ctx
        at = np.minimum(np.searchsorted(ids, ask), len(ids) - 1)
        hit = (ids[at] == ask) & np.repeat(there, per)
        p[hit] = sums[at[hit]]
    return packed(np.log10(p / len(opens)).astype("<f4").view("<u4"))


def answers(slices: DataFrame, past: list[Past], s: Sampling, count: int) -> DataFrame:
    """``batch``, ``slice`` and the answer to each request. ``past``: every
    seating, of which the last ones are averaged."""
    used = past[len(past) - s.averaged:]
    seats = [(p.number, p.sums) for p in used]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for at, known, contexts, names, bodies in zip(*(c.to_pylist() for c in left.columns), strict=True):
            x, sums, parents, opens, unknown = first_seating(known, contexts), 0.0, [], [], []
            for number, g in seats:
                g = given(x, right, g, number, count)
                sums = sums + probabilities(x, g, s)
                parents.append(parent_probability(parent_customers(x), x["top_tables"], g, s)[0])
                opens.append((s.strength + g.discount * g.tables) / (s.strength + g.customers))
                unknown.append(parent_probability(np.zeros(0), np.zeros(0), g, s)[1])
            replies = [answer(body, x, sums, parents, opens, unknown) for body in bodies]
            out.append(pa.Table.from_arrays([pa.array(names), pa.array([at] * len(names), pa.int32()), pa.array(replies, pa.binary())], schema=PLACED))
        return pa.concat_tables(out)

    told = [x for p in used for x in (p.states(), p.replies)] + ([] if used[0].number == 0 else [past[0].replies])
    return slices.select("slice", "known", "contexts", "batches", "bodies").groupBy("slice").cogroup(
        reduce(DataFrame.unionByName, told).groupBy("slice")).applyInArrow(run, PLACED_DDL)


def document_scores(held: DataFrame, vocab: DataFrame, replies: DataFrame, g: Totals, kind: str, slices: int) -> DataFrame:
    """Per document: the sums over its tokens. The batch's pairs are numbered again."""
    words, tokens = g.words, g.tokens

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = pa.compute.field("of_words")
        ids, count = word_ids(right.filter(known))
        logs = [unpacked(x)[0] for x in right.filter(~known).sort_by("slice").column("body").to_pylist()]
        logp = np.concatenate(logs).astype("<u4").view("<f4").astype(np.float64)
        base = np.log10((count + 1.0) / (tokens + words + 1))
        out = []
        for row in left.to_pylist():
            pid, token = batch_pairs(row, ids, slices)[-1], unpacked(row["tokens"])[0].astype(np.int64)
            at = np.concatenate([[0], np.cumsum(row["sizes"])])[:-1]
            sums = [np.add.reduceat(v, at) for v in (logp[pid], base[token], (count > 0).astype(np.int64)[token])]
            out.append(pa.table({"row_key": pa.array(row["keys"], left.schema.field("keys").type.value_type),
                                 "learned": pa.array(row["learn"], pa.bool_()), "n_tokens": pa.array(row["sizes"], pa.int64()),
                                 "n_known": pa.array(sums[2]), "base_score": pa.array(sums[1]), "score": pa.array(sums[0])}))
        return pa.concat_tables(out)

    told = vocab.withColumn("of_words", F.lit(True)).unionByName(replies.withColumn("of_words", F.lit(False)))
    x = held.select("batch", "keys", "learn", "sizes", "tokens").groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(
        run, f"row_key {kind}, learned boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return x.withColumn("train_tokens", F.lit(int(tokens)).cast("bigint"))


def scored(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", sampling: Sampling = Sampling(),
           slices: int | None = None) -> DataFrame:
    """``row_key``, ``learned``, ``n_tokens``, ``n_known``, ``base_score``
    (add-one over single words), ``score`` (log10 probability of the model) and
    ``train_tokens`` of every document, learning from those where ``learn``.
    ``slices`` of the words: by default the shuffle's partitions, and one per
    ``SLICE_TOKENS`` at least."""
    s, parts = sampling, slices or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = bucketed(batches(df, learn, min(parts, RANGES), key, text), "batch", parts)
    if not slices:
        n = held.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b))).first()[0]
        slices = max(parts, -(-(n or 0) // SLICE_TOKENS))
    vocab = written(vocabulary(held), "vocabulary")
    rows = bucketed(slice_rows(requests(held, vocab, slices)), "slice", slices)

    def first(b: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in b:
            for at, known, contexts in zip(*(c.to_pylist() for c in x.columns), strict=True):
                yield from sweep_rows(first_seating(known, contexts), 0, at, slices).to_batches()

    past = [seated(rows.select("slice", "known", "contexts").mapInArrow(first, SWEEP_DDL), [])]
    for _ in range(s.sweeps):
        past.append(seated(swept(rows, past, s, slices), past))
    replies, kind = answers(rows, past, s, slices), df.schema[key].dataType.simpleString()
    return document_scores(held, vocab, replies, past[-1].sums, kind, slices)


def perplexity(scores: DataFrame) -> DataFrame:
    """Per-token perplexity of learned and held-out documents."""
    return scores.groupBy("learned").agg(
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"))
