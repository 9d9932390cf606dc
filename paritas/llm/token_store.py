"""Token files with keyed access.

``write`` encodes every whole text, appends an end id, and writes the ids in
ascending key order as shards. A shard is one row of a Parquet table with

* ``part``, ``seq``: its place in the order; ``first_key``, ``last_key``,
  ``n_docs``, ``n_null`` (leading documents without a key), ``n_ids``;
* ``keys``, ``ends``: keys (int64) and last ids' ends (int64) of its documents;
* ``payload``: the raw ids, little-endian, ``width`` bytes each;
* ``index``: a minimal perfect hash of its distinct keys with, per slot, a
  32-bit fingerprint of the key, the first id's offset and the id count.

Spark's own writer commits the shards, so the files live wherever Spark can
write, and lost tasks leave nothing behind. In a shard's index a lookup touches
a bit per level, one block of the rank directory and one slot, and then one
slice of the payload: constant work per key, and a key that is not there fails
the fingerprint (a false hit has probability 2**-32). The cells of a shard are
read whole, so a lookup of few keys costs the reading of their shards.

Defined results: null and empty texts are the end id alone; null keys come
first and cannot be looked up; documents with equal keys lie side by side
(ordered by their text's hash) and a lookup gives all their ids in that order;
other columns are neither read nor returned; an empty table gives no shard.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paritas.llm.pieces import mix
from paritas.llm.token_counts import WORD_PARTS

SHARD_IDS = 2_000_000
SHARD_SCHEMA = ("part int, seq int, first_key bigint, last_key bigint, n_docs bigint, n_null bigint, n_ids bigint, "
                "width int, keys binary, ends binary, index binary, payload binary")

# ---------------------------------------------------------------- encoding


class Encoder:
    """The tokenizers library, with the ids of parts it has met kept within a
    bound. A text is cut where no token can cross (``WORD_PARTS``), so parts
    encode independently; a plain word needs no pre-tokenizer."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        spec = json.load(open(tokenizer_file, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level tokenizer without normalizer or prefix space is needed")
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.pre, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        # How the pre-tokenizer writes a byte: letters spell most of them directly.
        shown = {b: self.pre.pre_tokenize_str(chr(b)) for b in range(128)}
        self.byte = {b: x[0][0] for b, x in shown.items()}
        for c in map(chr, range(128, 0x250)):
            got = self.pre.pre_tokenize_str(c)
            self.byte.update(zip(c.encode(), got[0][0], strict=True))
        self.line_break = self.ids(self.byte[10])
        self.parts = _Parts(self)

    def ids(self, word: str) -> bytes:
        """Raw ids of one pre-tokenized word."""
        got = self.model.tokenize(word)
        return struct.pack(f"<{len(got)}{'HI'[self.width // 4]}", *[t.id for t in got])

    def fresh(self, part: str) -> bytes:
        """Ids of a part, its words through the pre-tokenizer and the model."""
        return b"".join([self.ids(w) for w, _ in self.pre.pre_tokenize_str(part)])

    def document(self, text: str) -> bytes:
        """Raw ids of a text as ``encode(text, add_special_tokens=False)`` of the
        library gives them: an added token's string in it is that token."""
        if any(t in text for t in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}{'HI'[self.width // 4]}", *ids)
        return self.encode(text)

    def encode(self, text: str) -> bytes:
        """Raw ids of a text (special tokens' strings are ordinary text)."""
        return b"".join(map(self.parts.__getitem__, WORD_PARTS.findall(text)))


#: A plain word (letters on which every version of the character tables agrees), with a blank or line break before it.
PLAIN_RE = re.compile(r"([ \n]?)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)")


class _Parts(dict):
    """Ids of parts, in two generations: a full one becomes the old one, and a
    part that is met again moves back. Long parts are not kept."""

    MOST, LONGEST = 600_000, 64

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, part: str) -> bytes:
        got = self.old.pop(part, None)
        if got is None:
            got = self.first(part)
        if len(part) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.old = dict(self)
                self.clear()
            self[part] = got
        return got

    def first(self, part: str) -> bytes:
        e = self.encoder
        m = PLAIN_RE.fullmatch(part)
        if not m:
            return e.fresh(part)
        lead, word = m.groups()
        shown = "".join([e.byte[b] for b in (word if lead == "\n" else part).encode()])
        return e.line_break + e.ids(shown) if lead == "\n" else e.ids(shown)


# ---------------------------------------------------------------- minimal perfect hash

SEED = np.uint64(0xA0761D6478BD642F)
GAMMA = 1.5


def level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys ^ mix(np.array([(int(SEED) * (level + 1)) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (level_hash(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels of bit rows: a key owns the first bit that it alone falls on.
    Returns the bits, the bit count of each level, and each key's slot."""
    keys = keys.view(np.uint64)
    left, rows, sizes, owner = np.arange(len(keys)), [], [], []
    while len(left):
        size = max(int(GAMMA * len(left)), 1)
        place = (level_hash(keys[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        count = np.bincount(place, minlength=size)
        alone = count[place] == 1
        bits = np.zeros(size, dtype=bool)
        bits[place[alone]] = True
        at = np.full(size, -1, dtype=np.int64)
        at[place[alone]] = left[alone]
        rows.append(bits)
        owner.append(at[bits])
        sizes.append(size)
        left = left[~alone]
    slots = np.empty(len(keys), dtype=np.int64)
    slots[np.concatenate(owner) if owner else []] = np.arange(len(keys))
    bits = np.concatenate(rows) if rows else np.zeros(0, dtype=bool)
    return bits, np.array(sizes, dtype=np.int64), slots


#: Bits of a block of the rank directory, in 64-bit words.
RANK_WORDS = 8


def pack_index(keys: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> bytes:
    """The index section for distinct keys with their first id and id count:
    level sizes, the ones before each block of bits, the bits, and the slots."""
    bits, sizes, slots = build_hash(keys)
    blocks = -(-len(bits) // (64 * RANK_WORDS))
    full = np.zeros(blocks * 64 * RANK_WORDS, dtype=bool)
    full[:len(bits)] = bits
    set_bits = full.reshape(blocks, 64 * RANK_WORDS).sum(axis=1)
    before = np.cumsum(set_bits) - set_bits
    prints, off, num = (np.empty(len(keys), dtype=t) for t in ("<u4", "<i8", "<i8"))
    prints[slots], off[slots], num[slots] = fingerprint(keys.view(np.uint64)), offsets, counts
    head = np.array([len(keys), len(sizes), blocks], dtype="<i8")
    return b"".join(x.tobytes() for x in (head, sizes.astype("<i8"), before.astype("<i8"), np.packbits(full, bitorder="little"),
                                          off, num, prints))


def find_keys(index: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First id and id count of each key in a shard, count -1 where absent. A
    key touches a bit per level, one block of bits and one slot, however many
    keys the shard has."""
    n, levels, blocks = (int(x) for x in np.frombuffer(index, dtype="<i8", count=3))
    at = 24

    def section(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(index, dtype=kind, count=count, offset=at)
        at += x.nbytes
        return x

    sizes, before, bits = section("<i8", levels), section("<i8", blocks), section("<u8", blocks * RANK_WORDS)
    off, num, prints = section("<i8", n), section("<i8", n), section("<u4", n)
    keys = np.asarray(keys, dtype=np.int64).view(np.uint64)
    bit = np.full(len(keys), -1, dtype=np.int64)
    left, start = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        place = start + (level_hash(keys[left], level) % np.uint64(size)).astype(np.int64)
        hit = (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        bit[left[hit]] = place[hit]
        left, start = left[~hit], start + int(size)
    slot = np.full(len(keys), -1, dtype=np.int64)
    there = bit >= 0
    own = bit[there]
    block = own // (64 * RANK_WORDS)
    words = bits.reshape(blocks, RANK_WORDS)[block] if len(own) else np.zeros((0, RANK_WORDS), dtype=np.uint64)
    ahead = own[:, None] - block[:, None] * (64 * RANK_WORDS) - 64 * np.arange(RANK_WORDS)  # bits of each word before the key's own
    mask = np.where(ahead >= 64, ~np.uint64(0), (np.uint64(1) << np.clip(ahead, 0, 63).astype(np.uint64)) - np.uint64(1))
    slot[there] = before[block] + np.bitwise_count(words & np.where(ahead > 0, mask, np.uint64(0))).sum(axis=1)
    there[there] = prints[slot[there]] == fingerprint(keys[there])
    offsets, counts = np.zeros(len(keys), dtype=np.int64), np.full(len(keys), -1, dtype=np.int64)
    offsets[there], counts[there] = off[slot[there]], num[slot[there]]
    return offsets, counts


# ---------------------------------------------------------------- write


def shard(part: int, seq: int, width: int, keys: list, docs: list[bytes]) -> dict:
    """One shard row of documents in key order (null keys first)."""
    sizes = np.array([len(d) // width for d in docs], dtype=np.int64)
    ends = np.cumsum(sizes)
    n_null = sum(k is None for k in keys)
    own = np.array(keys[n_null:], dtype=np.int64)
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, dtype=np.int64)
    starts = (ends - sizes)[n_null:]
    reach = np.concatenate([starts[new[1:]], ends[-1:]]) if len(own) else ends[:0]
    return {"part": part, "seq": seq, "first_key": int(own[0]) if len(own) else None,
            "last_key": int(own[-1]) if len(own) else None, "n_docs": len(keys), "n_null": n_null,
            "n_ids": int(ends[-1]), "width": width, "keys": own.astype("<i8").tobytes(),
            "ends": ends.astype("<i8").tobytes(), "index": pack_index(own[new], starts[new], reach - starts[new]),
            "payload": b"".join(docs)}


def write(df: DataFrame, path: str, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text",
          shard_ids: int = SHARD_IDS) -> None:
    """Encode ``df`` and write its shards below ``path``. A shard closes at
    ``shard_ids`` ids, so a task holds one shard and one batch of texts."""
    rows = df.select(F.col(key).cast("bigint").alias("row_key"), F.col(text).alias("row_text"))
    # Equal keys are told apart by their text's hash, so one key's documents can spread over shards.
    ordered = rows.repartitionByRange("row_key", F.xxhash64("row_text")) \
        .sortWithinPartitions("row_key", F.xxhash64("row_text"))
    fields = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()),
                        ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()),
                        ("keys", pa.binary()), ("ends", pa.binary()), ("index", pa.binary()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        part, seq, keys, docs, held = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            encoder = encoder or worker_encoder(tokenizer_file)
            end = int(end_id).to_bytes(encoder.width, "little")
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encoder.document(t or "") + end
                keys.append(k)
                docs.append(ids)
                held += len(ids) // encoder.width
                if held >= shard_ids:
                    yield pa.RecordBatch.from_pylist([shard(part, seq, encoder.width, keys, docs)], fields)
                    seq, keys, docs, held = seq + 1, [], [], 0
        if keys:
            yield pa.RecordBatch.from_pylist([shard(part, seq, encoder.width, keys, docs)], fields)

    ordered.mapInArrow(run, SHARD_SCHEMA).write.option("parquet.block.size", str(32 << 20)).parquet(path)


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(tokenizer_file: str) -> Encoder:
    """One encoder per worker process, kept between its tasks."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


# ---------------------------------------------------------------- read


def shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part``, ``seq`` and the number of ids before each shard. Sums per
    part are added up first: one row per write task, a bounded number."""
    rows = shards(spark, path).select("part", "seq", "n_ids")
    per_part = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return rows.withColumn("inside", inside).join(before, "part") \
        .select("part", "seq", (F.col("before") + F.col("inside")).alias("shard_start"))


def placed(keys: np.ndarray, ends: np.ndarray, index: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First id and id count of each document of a shard: those of a key by the
    index, those without a key (the first ones) by their ends. Documents with
    equal keys share one entry, which their ends cut. An index that does not
    agree with the ends is an error."""
    n_null = len(ends) - len(keys)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    counts = ends - starts
    if not len(keys):
        return starts, counts
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.diff(np.append(new, len(keys)))
    offset, count = find_keys(index, keys[new])
    own = counts[n_null:]
    if (count != np.add.reduceat(own, new)).any() or (offset != starts[n_null:][new]).any():
        raise ValueError("the index of a shard does not lead to its documents")
    before = np.cumsum(own) - own
    starts[n_null:] = np.repeat(offset, times) + before - np.repeat(before[new], times)
    one = new[times == 1]
    counts[n_null + one] = count[times == 1]
    return starts, counts


def directory(spark: SparkSession, path: str) -> DataFrame:
    """Every document as the files have it, in their order: ``key``, ``start``
    (ids before it), ``n_ids`` and ``ids_crc32`` of the ids that its shard's
    index leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, n_null, width, keys, ends, index, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(payload, dtype=f"<u{width}").astype("<u4", copy=False)
                keys = np.frombuffer(keys, dtype="<i8")
                starts, counts = placed(keys, np.frombuffer(ends, dtype="<i8"), index)
                own = [None] * n_null + keys.tolist()
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()),
                     pa.array(starts), pa.array(counts),
                     pa.array([zlib.crc32(ids[s:s + c].tobytes()) for s, c in zip(starts, counts, strict=True)], pa.int64())],
                    ["key", "part", "seq", "local_start", "n_ids", "ids_crc32"])

    rows = shards(spark, path).select("part", "seq", "n_null", "width", "keys", "ends", "index", "payload").mapInArrow(
        run, "key bigint, part int, seq int, local_start bigint, n_ids bigint, ids_crc32 bigint")
    return rows.join(shard_starts(spark, path), ["part", "seq"]).select(
        "key", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_ids", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids`` of every distinct non-null key that the files hold.
    Keys reach their shards through buckets of the key range (each shard covers
    a few), and only those shards' indexes and payloads are read."""
    wanted = keys.select(F.col(key).cast("bigint").alias("k")).where("k IS NOT NULL").distinct()
    ranges = shards(spark, path).select("part", "seq", "first_key", "last_key").where("first_key IS NOT NULL")
    lo, hi, n = ranges.agg(F.min("first_key"), F.max("last_key"), F.count(F.lit(1))).first()
    if not n:
        return wanted.limit(0).select(F.col("k").alias(key), F.array().cast("array<bigint>").alias("ids"))
    width = max(1, -(-(hi - lo + 1) // n))
    bucket = lambda c: F.floor((F.col(c).cast("decimal(38,0)") - F.lit(lo)) / F.lit(width)).cast("bigint")
    cover = ranges.withColumn("bucket", F.explode(F.sequence(bucket("first_key"), bucket("last_key"))))
    pairs = wanted.where(F.col("k").between(lo, hi)).withColumn("bucket", bucket("k")).join(cover, "bucket") \
        .where(F.col("k").between(F.col("first_key"), F.col("last_key"))).select("k", "part", "seq")
    body = shards(spark, path).select("part", "seq", "width", "index", "payload")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_k, out_seq, out = [], [], []
        for part, seq, size, index, payload in zip(*(c.to_pylist() for c in right.columns), strict=True):
            want = left.column("k").to_numpy()
            ids = np.frombuffer(payload, dtype=f"<u{size}")
            for k, o, c in zip(want, *find_keys(index, want), strict=True):
                if c >= 0:
                    out_k.append(int(k))
                    out_seq.append((part << 32) + seq)
                    out.append(ids[o:o + c].astype(np.int64))
        return pa.table({"k": pa.array(out_k, pa.int64()), "place": pa.array(out_seq, pa.int64()),
                         "ids": pa.array(out, pa.list_(pa.int64()))})

    got = pairs.groupBy("part", "seq").cogroup(body.groupBy("part", "seq")) \
        .applyInArrow(run, "k bigint, place bigint, ids array<bigint>")
    # A key whose documents spread over shards: its pieces in shard order.
    whole = got.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("place", "ids"))).alias("x"))
    return whole.select(F.col("k").alias(key), F.flatten(F.transform("x", lambda s: s["ids"])).alias("ids"))
