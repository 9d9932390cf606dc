"""Sampled piece encoding: forward filtering, backward sampling.

All segmentations of a text into vocabulary pieces form a lattice. The forward
pass sums, per position, the weight of every way to reach it; the backward
pass draws one segmentation from the exact distribution, edge by edge. No
piece crosses from another character into a space mark or touches a line
break, so a text falls apart into chunks whose lattices are independent: a
batch filters each distinct chunk once and then samples all occurrences
together, in numpy.

The random numbers are a hash of (seed, row key, chunk number, step), so a row
always gets the same segmentation, wherever and however often it is computed.

Decoding is lossless for every text: characters outside the vocabulary, and a
space mark that stands in the text itself, go through byte pieces.

Defined results: null and empty texts have no pieces and decode to the empty
text; rows with the same key and text get the same pieces; a null key is a key
like any other; other columns are neither read nor returned; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Characters before which a chunk may end after a word, if no piece crosses there.
STOPS = ".,;:!?|"
#: Texts are handled in groups of at most this many characters (or one text).
GROUP_CHARS = 1_500_000

MUL = np.uint64(0x9E3779B97F4A7C15)
ROLL = np.uint64(1_000_003)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit hashes."""
    return (mix(x) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a SentencePiece model, with hash tables for lattice lookups."""
    prefixes: np.ndarray      # sorted hashes of all prefixes of pieces
    piece_of: np.ndarray      # the piece that ends there, or -1
    weight: np.ndarray        # log weight per piece id
    byte_id: np.ndarray       # piece id per byte
    unknown: float            # log weight of a character given in bytes
    longest: int
    bytes_of: list[bytes]     # what a piece decodes to
    cut: re.Pattern           # finds the chunks


def chunk_pattern(pieces: list[str]) -> re.Pattern:
    """Chunks: line breaks; else space marks with what follows them up to the
    next mark, cut after a word where a stop follows that no piece has there."""
    crossed = {b for p in pieces for a, b in zip(p, p[1:]) if b in STOPS and (a.isalnum() or a == "_")}
    stops = "".join(re.escape(c) for c in STOPS if c not in crossed)
    if not stops:
        return re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
    body = f"(?:[^{MARK}\n{stops}]+|(?<!\\w)[{stops}])"
    return re.compile(f"\n|(?:[{stops}]|{MARK}+){body}*|{body}+")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def load(model_file: str, flatness: float = 1.0) -> Vocabulary:
    """Read a model. Log weights are its scores for a unigram model; where the
    scores are merge ranks, a piece of rank r weighs 1 / (r + 2), Zipf's law.
    Both are multiplied by ``flatness`` (below 1: more varied samples)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = sp.get_piece_size()
    plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    score = np.array([sp.get_score(i) for i in range(size)])
    ranks = bool(np.all(score[plain] <= 0) and np.all(score[plain] == np.round(score[plain])))
    weight = flatness * (-np.log(2.0 - np.minimum(score, 0)) if ranks else score)
    byte_id = np.full(256, -1, dtype=np.int64)
    bytes_of = [b""] * size
    for i in range(size):
        if sp.is_byte(i):
            byte_id[int(sp.id_to_piece(i)[1:-1], 16)] = i
            bytes_of[i] = bytes([int(sp.id_to_piece(i)[1:-1], 16)])
    if (byte_id < 0).any():
        raise ValueError("the model has no piece for some byte, so decoding could lose text")
    table: dict[int, int] = {}
    longest = 1
    for i in plain:
        piece = sp.id_to_piece(i)
        body = piece.lstrip(MARK)
        if "\n" in piece or MARK in body:
            continue  # would cross a chunk
        bytes_of[i] = piece.replace(MARK, " ").encode()
        longest = max(longest, len(piece))
        h = 0
        for n, c in enumerate(piece, 1):
            h = (h * int(ROLL) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            if n < len(piece):
                table.setdefault(h, -1)
        table[h] = i
    keys = np.array(sorted(table), dtype=np.uint64)
    return Vocabulary(keys, np.array([table[int(k)] for k in keys], dtype=np.int64), weight, byte_id,
                      float(weight[plain].min()) - 10.0 * flatness, longest, bytes_of,
                      chunk_pattern([sp.id_to_piece(i) for i in plain]))


@dataclass
class Lattice:
    """Sampling tables of the chunks of one group. A node is a chunk and a
    position in it; nodes are numbered by position, then by falling length of
    the chunk, so the nodes of one position are neighbours."""
    last: np.ndarray     # final node of each chunk
    chunks: int          # nodes below this number are starts
    bound: np.ndarray    # node + cumulative probability, ascending over all edges
    back: np.ndarray     # node an edge comes from
    piece: np.ndarray    # its piece id, or -1 - code point for bytes


def lattice(vocab: Vocabulary, chunks: list[str], literal: list[str]) -> Lattice:
    """Forward filtering of every chunk. ``literal``: the chunks as in the text,
    whose own space marks are no piece's."""
    size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
    rank_of = np.empty(len(chunks), dtype=np.int64)
    rank_of[np.argsort(-size, kind="stable")] = np.arange(len(chunks))
    joined, given = code_points("".join(chunks)), code_points("".join(literal))
    n = len(joined)
    rank, length = np.repeat(rank_of, size), np.repeat(size, size)
    offset = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    # live[j]: chunks with at least j characters; base[j]: the first node of position j.
    top = int(size.max(initial=0))
    live = len(chunks) - np.searchsorted(np.sort(size), np.arange(top + 1), side="left")
    base = np.cumsum(live) - live
    raw = given == ord(MARK)
    pos, h = np.flatnonzero(~raw), np.zeros(n, dtype=np.uint64)
    alone = np.ones(n, dtype=bool)  # no piece of one character
    ends, backs, ids = [], [], []
    for k in range(min(vocab.longest, top)):
        pos = pos[length[pos] - offset[pos] > k]
        if raw.any():
            pos = pos[~raw[pos + k]]
        h[pos] = h[pos] * ROLL + joined[pos + k] + np.uint64(1)
        at = np.searchsorted(vocab.prefixes, h[pos])
        at[at == len(vocab.prefixes)] = 0
        hit = vocab.prefixes[at] == h[pos]
        pos, at = pos[hit], at[hit]
        piece = vocab.piece_of[at]
        full = piece >= 0
        from_, r = pos[full], rank[pos[full]]
        if not k:
            alone[from_] = False
        ends.append((base[offset[from_] + k + 1] + r).astype(np.int32))
        backs.append((base[offset[from_]] + r).astype(np.int32))
        ids.append(piece[full].astype(np.int32))
    from_ = np.flatnonzero(alone)
    ends.append((base[offset[from_] + 1] + rank[from_]).astype(np.int32))
    backs.append((base[offset[from_]] + rank[from_]).astype(np.int32))
    ids.append((-1 - given[from_].astype(np.int64)).astype(np.int32))
    del pos, h, rank, length, offset, given, joined, raw, alone
    by = np.argsort(np.concatenate(ends), kind="stable")
    end, back, piece = np.concatenate(ends)[by], np.concatenate(backs)[by], np.concatenate(ids)[by]
    del ends, backs, ids, by
    weight = np.where(piece >= 0, vocab.weight[np.maximum(piece, 0)], vocab.unknown)
    alpha = np.zeros(int(live.sum()))
    first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))  # each node's first edge
    bound = np.empty(len(end))
    node_at = base[1:] - len(chunks)  # index into ``first`` of each position's first node
    cuts = np.concatenate([first, [len(end)]])
    for j in range(1, top + 1):
        lo, hi = int(node_at[j - 1]), int(node_at[j - 1] + live[j])
        a, b = int(cuts[lo]), int(cuts[hi])
        seg = first[lo:hi] - a
        many = np.diff(cuts[lo:hi + 1])
        score = alpha[back[a:b]] + weight[a:b]
        peak = np.maximum.reduceat(score, seg)
        e = np.exp(score - np.repeat(peak, many))
        total = np.add.reduceat(e, seg)
        node = int(base[j])
        alpha[node:node + live[j]] = peak + np.log(total)
        run = np.cumsum(e)
        cum = (run - np.repeat(run[seg] - e[seg], many)) / np.repeat(total, many)
        cum = np.minimum(cum, 1 - 1e-9)
        cum[np.concatenate([seg[1:], [b - a]]) - 1] = 1.0
        bound[a:b] = end[a:b] + cum
    return Lattice(base[size] + rank_of, len(chunks), bound, back, piece)


def row_seed(key: object, seed: int) -> int:
    return xxhash.xxh64_intdigest(repr(key).encode(), seed=seed & 0xFFFFFFFFFFFFFFFF)


def encode_group(vocab: Vocabulary, keys: list, texts: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the texts, one after the other, and the end of each text."""
    found: list = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if not t:
            continue
        chunks = vocab.cut.findall(MARK + t.replace(" ", MARK))
        if MARK in t:  # a mark of the text itself: chunks differ by what they stand for
            given, at, pairs = " " + t, 0, []
            for c in chunks:
                pairs.append((c, given[at:at + len(c)]))
                at += len(c)
            chunks = pairs
        counts[i] = len(chunks)
        found += chunks
    ends = np.cumsum(counts)
    if not found:
        return np.zeros(0, dtype=np.int32), ends
    index = {c: i for i, c in enumerate(dict.fromkeys(found))}
    which = np.fromiter(map(index.__getitem__, found), dtype=np.int64, count=len(found))
    del found
    plain = [c if isinstance(c, str) else c[0] for c in index]
    literal = [c.replace(MARK, " ") if isinstance(c, str) else c[1] for c in index]
    lat = lattice(vocab, plain, literal)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    number = (np.arange(len(which)) - np.repeat(ends - counts, counts)).astype(np.uint64)
    seeds = np.array([row_seed(k, seed) for k in keys], dtype=np.uint64)
    stream = mix(seeds[text_of] + (number + np.uint64(1)) * MUL)
    last = lat.last[which]
    occ = np.argsort(last, kind="stable")  # neighbours in the tables, for the caches
    node, stream = last[occ], stream[occ]
    drawn, length = [], np.zeros(len(which), dtype=np.int64)
    while len(occ):
        stream = stream + MUL
        edge = np.searchsorted(lat.bound, node + unit(stream), side="right")
        drawn.append((occ, lat.piece[edge]))
        length[occ] += 1
        node = lat.back[edge]
        go = node >= lat.chunks
        occ, node, stream = occ[go], node[go], stream[go]
    close = np.cumsum(length)
    ids = np.empty(int(close[-1]), dtype=np.int32)
    for s, (at, piece) in enumerate(drawn):
        ids[close[at] - 1 - s] = piece
    text_end = np.concatenate([[0], close])[ends]
    low = ids < 0
    if low.any():
        ids, text_end = in_bytes(vocab, ids, low, text_end)
    return ids.astype(np.int32), text_end


def in_bytes(vocab: Vocabulary, ids: np.ndarray, low: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each ``-1 - code point`` by the byte pieces of its UTF-8 form."""
    points = -1 - ids[low].astype(np.int64)
    wide = np.ones(len(ids), dtype=np.int64)
    wide[low] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    close = np.cumsum(wide)
    out = np.repeat(ids, wide)
    raw = np.frombuffer("".join(map(chr, points)).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out[np.repeat(low, wide)] = vocab.byte_id[raw]
    return out, np.concatenate([[0], close])[ends]


def groups(keys: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP_CHARS:
            yield keys[at:i], texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield keys[at:], texts[at:]


def decode(vocab: Vocabulary, ids) -> str:
    """The text of a sequence of piece ids."""
    got = b"".join(map(vocab.bytes_of.__getitem__, ids))
    return got[1:].decode("utf-8", "surrogatepass") if got[:1] == b" " else got.decode("utf-8", "surrogatepass")


def encoded(df: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", seed: int = 1,
            flatness: float = 1.0) -> DataFrame:
    """``key``, ``ids`` (array of int), ``n_ids``, ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit integers) and ``lossless``, whether the ids
    decode to the text. Every worker loads the model from ``model_file``."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = None
        for b in batches:
            vocab = vocab or load(model_file, flatness)
            keys, texts, at = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()], 0
            for ks, ts in groups(keys, texts):
                ids, ends = encode_group(vocab, ks, ts, seed)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                parts = [ids[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(ks)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())),
                     pa.array(np.diff(offsets).astype(np.int64)),
                     pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                     pa.array([decode(vocab, p.tolist()) == t for p, t in zip(parts, ts, strict=True)], pa.bool_())],
                    ["row_key", "ids", "n_ids", "ids_crc32", "lossless"])
                at += len(ks)

    out = df.select(F.col(key).alias("row_key"), F.col(text).alias("row_text")).mapInArrow(
        run, f"row_key {kind}, ids array<int>, n_ids bigint, ids_crc32 bigint, lossless boolean")
    return out.withColumnRenamed("row_key", key)


def decoded(df: DataFrame, model_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the text of ``ids`` (null ids: the empty text)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = None
        for b in batches:
            vocab = vocab or load(model_file)
            texts = [decode(vocab, x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row_key", "text"])

    out = df.select(F.col(key).alias("row_key"), F.col(ids).alias("row_ids")) \
        .mapInArrow(run, f"row_key {kind}, text string")
    return out.withColumnRenamed("row_key", key)
