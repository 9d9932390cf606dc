"""N-gram Jaccard join by MinHash banding.

Documents with the same set of word n-grams are one class, whatever their
number; only classes go on. Their MinHash signatures are cut into bands, the
band and row counts chosen so that a pair at the threshold shares a band with
at least the target probability. Classes shuffle on their band hashes. A
bucket's members are dealt into blocks, and every two blocks meet in one task,
so no task sees an unbounded bucket and a hot one is spread over many. A pair
is counted in the first band that it shares, never twice. Buckets with the
same members (near copies share most bands) are worked on once.

A first pass over the blocks keeps only members with a partner whose
signatures agree well enough (a pair at the threshold is lost here with a
probability far below that of the banding); their full n-gram sets are then
fetched, and the second pass verifies each pair exactly. Tasks emit, per
class, its number of links and a spanning forest of its linked pairs, never
all pairs; connected classes get one id by alternating star contraction.

Defined results: a text of fewer words than n is one n-gram of all its words;
null, empty and blank texts have the empty set, equal to itself; repeated rows
are documents of their own and count as links of each other; a null key is
kept, and stands for its class only if the class has no other key; ties go to
the smaller key; other columns are neither read nor returned by the join; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import written
from paritas.llm.pieces import mix

N = 5
THRESHOLD = 0.8
RECALL = 1 - 1e-6
MOST_HASHES = 192
BLOCK_ROWS = 2000
BLOCK_GRAMS = 2_000_000
#: Share of equal signature places below which a pair is not verified; at the
#: threshold 0.8 and 175 places it loses a pair with probability below 1e-8.
LEAST_AGREEMENT = 0.61
KEY_BYTES = 16


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: as many rows as ``most`` hashes allow at this recall."""
    best = None
    for rows in range(1, most + 1):
        share = threshold ** rows  # chance that a band agrees
        bands = math.ceil(math.log(1 - recall) / math.log1p(-share)) if share < 1 else 1
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no banding of so few hashes reaches this recall")
    return best


class _Words(dict):
    MOST = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def grams(text: str, hashes: dict, n: int = N) -> np.ndarray:
    """The set of hashed word n-grams of a whole text, ascending."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out = mix(out ^ h[i:len(words) - k + 1 + i])
    return np.unique(out)


def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    b = mix(a)
    return (a >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (b >> np.uint64(32)).astype(np.uint32)


def signature(g: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values of a set (all ones for the empty set)."""
    low = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    x = (g ^ (g >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(x), 512):
        part = x[at:at + 512]
        np.minimum(low, (part[:, None] * a[None] + b[None]).min(axis=0), out=low)
    return low


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = sig[:bands * rows].reshape(bands, rows).astype(np.uint64)
    out = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        out = mix(out ^ (x[:, r] + np.uint64(((r + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)))
    return out.view(np.int64)


def signed(df: DataFrame, bands: int, rows: int, key: str, text: str, n: int = N) -> DataFrame:
    """``row_key``, ``row_hash`` (of the text), ``cls`` (128 bits of the n-gram
    set), ``n_grams``, ``bands`` and ``sig`` (low bytes of the signature)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        a, b = multipliers(bands * rows)
        for batch in batches:
            cls, size, band, sig = [], [], [], []
            for t in batch.column(2).to_pylist():
                g = grams(t or "", hashes, n)
                s = signature(g, a, b)
                cls.append(xxhash.xxh3_128_digest(g.tobytes()))
                size.append(len(g))
                band.append(band_hashes(s, bands, rows))
                sig.append(s.astype(np.uint8).tobytes())
            flat = np.concatenate(band) if band else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cls, pa.binary()), pa.array(size, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(cls) + 1, dtype=np.int32) * bands), pa.array(flat)),
                 pa.array(sig, pa.binary())], ["row_key", "row_hash", "cls", "n_grams", "bands", "sig"])

    rows_in = df.select(F.col(key).alias("row_key"), F.xxhash64(F.col(text)).alias("row_hash"), F.col(text).alias("row_text"))
    return rows_in.mapInArrow(run, f"row_key {kind}, row_hash bigint, cls binary, n_grams int, bands array<bigint>, sig binary")


def buckets(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Band rows of the classes, and the buckets with two members or more, one
    for each set of members (that of the lowest band), with its block count."""
    rows = reps.where("n_grams > 0").select("cls", "n_grams", F.posexplode("bands").alias("band", "h"))
    sizes = rows.groupBy("band", "h").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams"), F.bit_xor(F.xxhash64("cls")).alias("f1"),
        F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("f2")).where("n > 1")
    once = sizes.groupBy("n", "grams", "f1", "f2").agg(F.min(F.struct("band", "h")).alias("b"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    return rows, once.select("b.band", "b.h", parts.alias("parts"))


def in_blocks(members: DataFrame) -> DataFrame:
    """Every member (``band``, ``h``, ``parts``, ``cls``) once for each pair of
    blocks its block takes part in: ``bi`` <= ``bj``, ``own`` its block."""
    own = F.pmod(F.xxhash64("cls", "band"), F.col("parts")).cast("int")
    x = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return x.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other", "parts")


class Block:
    """Two blocks of one bucket (or one with itself) as arrays."""

    def __init__(self, t: pa.Table):
        t = t.sort_by("cls")
        self.cls = t.column("cls").to_pylist()
        self.band = t.column("band")[0].as_py()
        self.bi, self.bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
        own = t.column("own").to_numpy()
        self.left = np.flatnonzero(own == self.bi)
        self.right = np.flatnonzero(own == self.bj)
        n = len(self.cls)
        self.bands = t.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        self.sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(n, -1)
        self.size = t.column("n_grams").to_numpy()

    def pairs(self, least: float) -> Iterator[tuple[int, np.ndarray]]:
        """Per member its partners to look at: in this band first, signatures
        agreeing, set sizes that allow the threshold; every pair once."""
        same = self.bi == self.bj
        for i in self.left:
            js = self.right[self.right > i] if same else self.right
            ratio = np.minimum(self.size[js], self.size[i]) / np.maximum(self.size[js], self.size[i])
            js = js[ratio >= THRESHOLD - 1e-9]
            if self.band and len(js):
                js = js[~(self.bands[js, :self.band] == self.bands[i, :self.band]).any(axis=1)]
            if len(js):
                js = js[(self.sig[js] == self.sig[i]).mean(axis=1) >= least]
            if len(js):
                yield i, js


def promising(t: pa.Table) -> pa.Table:
    """Members of a pair of blocks that have a partner to verify."""
    block = Block(t)
    hit = np.zeros(len(block.cls), dtype=bool)
    for i, js in block.pairs(LEAST_AGREEMENT):
        hit[i] = True
        hit[js] = True
    at = np.flatnonzero(hit)
    n = len(at)
    return pa.table({"band": pa.array([block.band] * n, pa.int32()), "h": pa.array(t.column("h").to_pylist()[:1] * n, pa.int64()),
                     "bi": pa.array([block.bi] * n, pa.int32()), "bj": pa.array([block.bj] * n, pa.int32()),
                     "cls": pa.array([block.cls[i] for i in at], pa.binary())})


def verified(t: pa.Table) -> pa.Table:
    """Exact links of a pair of blocks: per class its linked classes and their
    documents (``b`` null), and a spanning forest of the links (``b`` set)."""
    block = Block(t)
    t = t.sort_by("cls")
    docs = t.column("docs").to_numpy()
    flat = np.frombuffer(b"".join(t.column("grams").to_pylist()), dtype=np.uint64)
    vocab, flat = np.unique(flat, return_inverse=True)
    start = np.concatenate([[0], np.cumsum(block.size)])
    mark = np.zeros(len(vocab), dtype=bool)
    n = len(block.cls)
    links, linked_docs, up, forest = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), list(range(n)), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, js in block.pairs(LEAST_AGREEMENT):
        mine = flat[start[i]:start[i + 1]]
        mark[mine] = True
        size = block.size[js]
        places = np.repeat(start[js] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        common = np.add.reduceat(mark[flat[places]].astype(np.int64), np.cumsum(size) - size)
        mark[mine] = False
        js = js[common >= THRESHOLD * (len(mine) + size - common) - 1e-9]
        if len(js):
            links[i] += len(js)
            linked_docs[i] += docs[js].sum()
            links[js] += 1
            linked_docs[js] += docs[i]
            for j in js.tolist():
                a, b = root(int(i)), root(j)
                if a != b:
                    up[max(a, b)] = min(a, b)
                    forest.append((min(a, b), max(a, b)))
    at = np.flatnonzero(links)
    return pa.table({
        "a": pa.array([block.cls[i] for i in at] + [block.cls[a] for a, _ in forest], pa.binary()),
        "b": pa.array([None] * len(at) + [block.cls[b] for _, b in forest], pa.binary()),
        "n_links": pa.array([*links[at].tolist(), *[0] * len(forest)], pa.int64()),
        "n_docs": pa.array([*linked_docs[at].tolist(), *[0] * len(forest)], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node) of each connected component of
    edges ``a``, ``b``, by alternating large and small stars."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct(), "edges")
        got = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``row_key``, ``row_hash`` (of its text),
    ``component`` (128 bits that name its class: classes may share a key),
    ``class_id`` (smallest key of the documents linked to it, directly or
    through others), ``copy_id`` (smallest key with the same n-gram set),
    ``n_links`` (other documents with a similarity of at least the threshold)
    and ``n_class_links`` (other n-gram sets so)."""
    bands, rows = banding()
    docs = written(signed(df, bands, rows, key, text), "signed")
    reps = written(docs.groupBy("cls").agg(
        F.min("row_key").alias("copy_id"), F.count(F.lit(1)).alias("docs"), F.min("row_hash").alias("any_hash"),
        F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    all_rows, kept = buckets(reps)
    members = written(all_rows.join(kept, ["band", "h"]).select("band", "h", "parts", "cls"), "members")
    signs = reps.select("cls", "n_grams", "bands", "sig")
    first = in_blocks(members).join(signs, "cls").groupBy("band", "h", "bi", "bj").applyInArrow(
        promising, "band int, h bigint, bi int, bj int, cls binary")
    first = written(first, "promising")
    # Full sets of the promising classes, from one text each.
    wanted = first.select("cls").distinct().join(reps.select("cls", "any_hash"), "cls")
    sets = written(gram_sets(df, wanted, text), "grams")
    own = F.pmod(F.xxhash64("cls", "band"), F.col("parts")).cast("int")
    again = first.join(members, ["band", "h", "cls"]).withColumn("own", own).drop("parts")
    found = again.join(signs, "cls").join(reps.select("cls", "docs"), "cls").join(sets, "cls") \
        .groupBy("band", "h", "bi", "bj").applyInArrow(verified, "a binary, b binary, n_links bigint, n_docs bigint")
    found = written(found, "links")
    degree = found.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n_links").alias("n_links"), F.sum("n_docs").alias("n_docs"))
    groups = components(found.where("b IS NOT NULL").select("a", "b"))
    ids = reps.select("cls", "copy_id").join(groups, F.col("cls") == F.col("node"))
    roots = ids.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    info = reps.select("cls", "copy_id", "docs") \
        .join(ids.join(roots, "root").select("cls", "class_id", "root"), "cls", "left").join(degree, "cls", "left")
    info = info.select("cls", F.coalesce("root", "cls").alias("component"), "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"),
                       (F.col("docs") - 1 + F.coalesce("n_docs", F.lit(0))).alias("n_links"),
                       F.coalesce("n_links", F.lit(0)).alias("n_class_links"))
    return docs.select("row_key", "row_hash", "cls").join(info, "cls").drop("cls")


def gram_sets(df: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """``cls`` and ``grams`` (sorted 64-bit hashes) of the wanted classes, from
    the texts with the hash ``any_hash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for b in batches:
            sets = [grams(t or "", hashes).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["cls", "grams"])

    texts = df.select(F.col(text).alias("row_text"), F.xxhash64(F.col(text)).alias("any_hash"))
    found = texts.join(wanted.select("any_hash").distinct(), "any_hash").dropDuplicates(["any_hash"])
    return found.select("row_text").mapInArrow(run, "cls binary, grams binary").dropDuplicates(["cls"]) \
        .join(wanted.select("cls"), "cls", "left_semi")


def one_per_class(df: DataFrame, joined: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` for each class, with its class id as key; of several
    rows of that key in the class, one of the text with the smallest hash.
    Classes that share a key, or have none, each keep their own row."""
    keep = joined.where(F.col("row_key").eqNullSafe(F.col("class_id"))).groupBy("component") \
        .agg(F.min("row_key").alias("kept_key"), F.min("row_hash").alias("kept_hash"), F.count(F.lit(1)).alias("n")).drop("component")
    keep = written(keep, "kept")
    # The row travels as one column, so its own names clash with none of these.
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), df[key].alias("key"), F.xxhash64(df[text]).alias("hash"))
    out = rows.join(keep, F.col("key").eqNullSafe(F.col("kept_key")) & (F.col("hash") == F.col("kept_hash")))
    if not keep.where("n > 1").isEmpty():
        out = out.dropDuplicates(["key", "hash"])
    return out.select("row.*")
