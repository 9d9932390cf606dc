"""Phrase collocations by direct-address tiling.

Texts are cut into pieces and words; the pieces of a group (a language) are
dealt into units of bounded size. Words that occur often enough get ids by
their frequency rank in the group. A pair of ids that stand side by side is a
cell of a tile of ``TILE`` by ``TILE`` ids; the frequent words share the first
tiles. A unit counts its pairs, and the counts of a tile meet in one place: a
tile with many cells by a dense ``numpy.bincount`` over the tile, a sparse one by
sorting its coordinates. Tiles are dealt to bundles whose number follows the
number of pairs, except the head tiles, which are bundles of their own and are
added up in rounds of ``FAN_IN`` units, so a hot pair or tile never gathers
all units in one task.

Frequent pairs get ids by their frequency rank in turn, a unit's words are
replaced by the pairs that start there, and the same tiling counts pairs of
overlapping pairs: phrases of three words.

What a unit needs to know (ids of its words, ranks of its pairs) reaches it by
joins on words and bundles, so no task and not the driver holds a vocabulary.

Ids have 31 bits; more frequent pairs in one group are an error, not a cut.
Scores are compared exactly in decimals of 38 digits, which holds while a
phrase occurs fewer than 10**15 times.

Defined results: null and empty texts have no words; a null group is ``und``;
repeated rows count each time; ties are broken as the ranking says, so the
result is unique; other columns are not read; an empty table has no phrases.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paritas.llm import common as C
from paritas.llm.merkle import numbered

#: Least number of occurrences of a candidate, share of a longer one that drops it, and score unit.
LEAST, COVERED_PERCENT, SCALE = 10, 50, 1_000_000
#: Words of a unit (a piece is never cut), and of all open units of a task.
UNIT_WORDS, OPEN_WORDS = 1_000_000, 4_000_000
#: Side of a tile in ids; tiles whose both ids are below ``HEAD`` tiles are head tiles.
TILE_BITS, HEAD = 10, 2
TILE = 1 << TILE_BITS
#: A tile is counted densely if it has one entry for so many cells.
SPARSE = 64
#: Pairs of a bundle of tiles, about; units whose head tiles are added up at once.
BUNDLE_PAIRS, FAN_IN = 2_000_000, 16

#: Row groups of tables with large cells, so that few are in memory at once.
BLOCK_BYTES = 16 << 20

#: Piece separators and the blank that is none, fixed by the definition of a phrase.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_TO_STOPS = bytes.maketrans(PIECE_ENDS + b"\t", b"." * len(PIECE_ENDS) + b" ")
_PIECE_END = re.compile(b"[.,;:!?\x0a-\x0d]")
STOP = b"."


def words(text: bytes) -> list[bytes]:
    """Words in lower case (A to Z), with a stop after each piece."""
    return text.lower().translate(_TO_STOPS).replace(STOP, b" . ").split()


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, compressed by planes of equal bytes."""
    x = np.ascontiguousarray(x)
    return zlib.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def unpacked(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zlib.decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


# ---------------------------------------------------------------- units


class _Ids(dict):
    """Ids by first appearance; 0 is the stop."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Open:
    """A group's unit that is still being filled."""

    def __init__(self):
        self.ids, self.parts, self.n = _Ids({STOP: 0}), [], 0

    def add(self, text: bytes) -> None:
        got = words(text)
        if got:
            self.parts.append(np.fromiter(map(self.ids.__getitem__, got), dtype=np.int32, count=len(got)))
            self.parts.append(np.zeros(1, dtype=np.int32))
            self.n += len(got)


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """The text in runs of whole pieces of some ``most`` bytes."""
    at = 0
    while len(text) - at > most and (end := _PIECE_END.search(text, at + most)):
        yield text[at:end.start()]
        at = end.start()
    yield text[at:]


UNIT_SCHEMA = "unit bigint, g string, body binary, words array<string>, counts array<bigint>"


def units(df: DataFrame, text: str, group: str, unit_words: int = UNIT_WORDS) -> DataFrame:
    """Units of the texts: ids by first appearance in the unit (0 after each
    piece), the words they stand for and how often each occurs."""
    rows = df.select(F.coalesce(F.col(group).cast("string"), F.lit("und")), F.col(text).cast("string").cast("binary")) \
        .toDF("g", "body").where("length(body) > 0")
    fields = pa.schema([("unit", pa.int64()), ("g", pa.string()), ("body", pa.binary()),
                        ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        opened: dict[str, _Open] = {}

        def close(g: str) -> pa.RecordBatch:
            nonlocal seq
            o = opened.pop(g)
            ids = np.concatenate(o.parts)
            counts = np.bincount(ids, minlength=len(o.ids))[1:]
            row = {"unit": (part << 32) + seq, "g": g, "body": packed(ids),
                   "words": [w.decode("utf-8", "replace") for w in o.ids if w != STOP], "counts": counts}
            seq += 1
            return pa.RecordBatch.from_pylist([row], fields)

        for b in batches:
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for x in pieces(t, 4 * unit_words):
                    o = opened.setdefault(g, _Open())
                    o.add(x)
                    if o.n >= unit_words:
                        yield close(g)
                if sum(o.n for o in opened.values()) >= OPEN_WORDS:
                    yield close(max(opened, key=lambda k: opened[k].n))
        for g in [g for g in opened if opened[g].n]:
            yield close(g)

    return rows.mapInArrow(run, UNIT_SCHEMA)


def word_ranks(parts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Words with at least ``least`` occurrences and their ids (from 1, by
    frequency), and all occurrences per group."""
    counts = parts.select("g", F.explode(F.arrays_zip("words", "counts")).alias("x")) \
        .groupBy("g", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    counts = C.written(counts, "words")
    ranked = numbered(counts.where(F.col("f") >= least).withColumn("down", -F.col("f")), "g", ["down", "word"], "word-ranks")
    return ranked.select("g", "word", "f", (F.col("pos") + 1).alias("id")), counts.groupBy("g").agg(F.sum("f").alias("total"))


SEQ_SCHEMA = "unit bigint, g string, body binary"


def encoded(parts: DataFrame, ranked: DataFrame) -> DataFrame:
    """Units with the words' ids: 0 after pieces, -1 for a word without id."""
    known = parts.select("unit", "g", F.posexplode("words").alias("local", "word")).join(ranked.select("g", "word", "id"), ["g", "word"]) \
        .groupBy("unit").agg(F.collect_list("local").alias("local"), F.collect_list("id").alias("id"))
    both = parts.select("unit", "g", "body").join(known, "unit", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for body, local, ids in zip(b.column(2), b.column(3), b.column(4), strict=True):
                seq = unpacked(body.as_py(), "<i4")
                table = np.full(int(seq.max(initial=0)) + 1, -1, dtype=np.int64)
                table[0] = 0
                if local.is_valid:
                    table[local.values.to_numpy() + 1] = ids.values.to_numpy()
                out.append(packed(table[seq]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["unit", "g", "body"])

    return both.mapInArrow(run, SEQ_SCHEMA)


# ---------------------------------------------------------------- tiles


def codes(seq: np.ndarray) -> np.ndarray:
    """Codes of neighbours that both have an id, first << 32 | second."""
    a, b = seq[:-1], seq[1:]
    both = (a > 0) & (b > 0)
    return (a[both] << np.int64(32)) | b[both]


def tile_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (code >> np.int64(32)) >> TILE_BITS, (code & np.int64(0xFFFFFFFF)) >> TILE_BITS


def bundle_of(code: np.ndarray, n: int) -> np.ndarray:
    """Head tiles are bundles -1, -2, ...; the others are dealt to ``n`` bundles."""
    r, c = tile_of(code)
    x = (r * np.int64(0x9E3779B1) + c * np.int64(0x85EBCA77)) & np.int64(0x7FFFFFFFFFFF)
    x ^= x >> np.int64(23)
    return np.where((r < HEAD) & (c < HEAD), -1 - (r * HEAD + c), x % np.int64(n))


def run_starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)


def counted(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted by tile and cell, and the sums of their counts:
    tile by tile, dense ones by direct address, sparse ones by sorting."""
    r, c = tile_of(code)
    cell = ((code >> np.int64(32)) & np.int64(TILE - 1)) << TILE_BITS | (code & np.int64(TILE - 1))
    tile = r << np.int64(31) | c
    order = np.argsort(tile, kind="stable")
    tile, cell, n = tile[order], cell[order], n[order]
    first = run_starts(tile)
    sizes = np.diff(np.append(first, len(tile)))
    dense = sizes * SPARSE >= TILE * TILE
    out_code, out_n = [], []

    def put(t, cells, sums):
        row = (t >> np.int64(31)) << TILE_BITS | cells >> TILE_BITS
        col = (t & np.int64(0x7FFFFFFF)) << TILE_BITS | cells & (TILE - 1)
        out_code.append(row << np.int64(32) | col)
        out_n.append(sums)

    for s, k in zip(first[dense], sizes[dense], strict=True):
        # Sums of whole numbers below 2**53 are exact in the float64 that bincount adds in.
        sums = np.bincount(cell[s:s + k], weights=n[s:s + k], minlength=TILE * TILE)
        there = np.flatnonzero(sums)
        put(tile[s], there, sums[there].astype(np.int64))
    rest = np.repeat(~dense, sizes)
    if rest.any():
        t, x, m = tile[rest], cell[rest], n[rest]
        order = np.lexsort((x, t))
        t, x, m = t[order], x[order], m[order]
        new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1])]))
        put(t[new], x[new], np.add.reduceat(m, new))
    if not out_code:
        return code[:0], n[:0]
    return np.concatenate(out_code), np.concatenate(out_n)


PART_SCHEMA = "g string, bundle bigint, unit bigint, codes binary, counts binary"
PART_FIELDS = pa.schema([("g", pa.string()), ("bundle", pa.int64()), ("unit", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])


def unit_counts(seqs: DataFrame, bundles: DataFrame, name: str) -> DataFrame:
    """What each unit counts, a row per bundle: sorted codes (as differences)
    and their counts. ``bundles`` has the number of bundles of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit, g, body, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                code = codes(unpacked(body, "<i8"))
                code, m = np.unique(code, return_counts=True)
                where = bundle_of(code, n)
                order = np.argsort(where, kind="stable")
                code, m, where = code[order], m[order], where[order]
                first = run_starts(where)
                rows = [(g, int(where[s]), unit, packed(np.diff(code[s:e], prepend=0)), packed(m[s:e]))
                        for s, e in zip(first, np.append(first, len(code))[1:], strict=True)]
                for at in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[at:at + 500], strict=True), PART_FIELDS, strict=True)],
                                                     schema=PART_FIELDS)

    return C.written(seqs.join(bundles, "g").select("unit", "g", "body", "bundles").mapInArrow(run, PART_SCHEMA), name, BLOCK_BYTES)


def merged(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """Counts added up per ``by`` (of ``g``, ``bundle``, ``unit``), those below ``least`` left
    out. Sorted rows stream through a task, which holds the counts of one
    bundle, compacted whenever they have doubled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n, base = None, [], 0, 1 << 20

        def add_up() -> tuple[np.ndarray, np.ndarray]:
            return counted(np.concatenate([x for x, _ in held]), np.concatenate([m for _, m in held]))

        def close() -> Iterator[pa.RecordBatch]:
            if key is not None:
                code, m = add_up()
                code, m = code[m >= least], m[m >= least]
                if len(code):
                    order = np.argsort(code)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], f.type) for x, f in zip((*key, packed(np.diff(code[order], prepend=0)), packed(m[order])), PART_FIELDS, strict=True)],
                        schema=PART_FIELDS)

        for b in batches:
            for g, bundle, unit, code, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (g, bundle, unit):
                    yield from close()
                    key, held, n, base = (g, bundle, unit), [], 0, 1 << 20
                held.append((np.cumsum(unpacked(code, "<i8")), unpacked(m, "<i8")))
                n += len(held[-1][0])
                if n > 2 * base:
                    held = [add_up()]
                    n = len(held[0][0])
                    base = max(n, 1 << 20)
        yield from close()

    return rows.repartition(*by).sortWithinPartitions(*by).select(*PART_FIELDS.names).mapInArrow(run, PART_SCHEMA)


def tiled(counts: DataFrame, least: int, name: str) -> DataFrame:
    """Frequent codes of all units, a row per group and bundle. Head tiles are
    added up by ``FAN_IN`` units at a time until so few are left."""
    groups = counts.select("g", "unit").distinct()
    numbers = numbered(groups, "g", ["unit"], f"{name}-units").select("g", "unit", "pos", "n")
    most = numbers.agg(F.max("n")).first()[0] or 0
    head = counts.where("bundle < 0").join(numbers, ["g", "unit"]).withColumn("unit", F.col("pos")).drop("pos", "n")
    while most > FAN_IN:
        head = C.written(merged(head.withColumn("unit", F.expr(f"unit div {FAN_IN}")), ["g", "bundle", "unit"], 1), f"{name}-head", BLOCK_BYTES)
        most = -(-most // FAN_IN)
    rest = counts.where("bundle >= 0").unionByName(head).withColumn("unit", F.lit(0).cast("bigint"))
    return C.written(merged(rest, ["g", "bundle"], least), name, BLOCK_BYTES)


def as_rows(bundles: DataFrame) -> DataFrame:
    """``g``, ``bundle``, ``code`` and ``f`` of packed counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, bundle, code, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                code, m = np.cumsum(unpacked(code, "<i8")), unpacked(m, "<i8")
                for s in range(0, len(code), 100_000):
                    k = len(code[s:s + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array([g] * k, pa.string()), pa.array([bundle] * k, pa.int64()),
                                                      pa.array(code[s:s + k]), pa.array(m[s:s + k])], ["g", "bundle", "code", "f"])

    return bundles.select("g", "bundle", "codes", "counts").mapInArrow(run, "g string, bundle bigint, code bigint, f bigint")


def ranked_codes(bundles: DataFrame, name: str) -> DataFrame:
    """Frequent codes with their id by frequency rank in the group."""
    rows = as_rows(bundles).withColumn("down", -F.col("f"))
    x = numbered(rows, "g", ["down", "code"], name)
    if (x.agg(F.max("n")).first()[0] or 0) >= 1 << 31:
        raise ValueError("a group has more frequent pairs than an id of 31 bits can number")
    return x.select("g", "bundle", "code", "f", (F.col("pos") + 1).alias("id"))


def answers(counts: DataFrame, ranked: DataFrame) -> DataFrame:
    """For each unit and bundle the frequent codes that the unit has, with
    their ids. Units meet a bundle's ids in slices of ``FAN_IN`` units."""
    slots = counts.select("g", "bundle", F.pmod(F.xxhash64("unit"), F.lit(1 << 20)).alias("h"), "unit", "codes")
    n = counts.groupBy("g", "bundle").agg(F.count(F.lit(1)).alias("n")) \
        .select("g", "bundle", F.expr(f"(n + {FAN_IN - 1}) div {FAN_IN}").alias("slices"))
    asked = slots.join(n, ["g", "bundle"]).select("g", "bundle", F.expr("h % slices").alias("slice"), "unit", "codes")
    known = ranked.groupBy("g", "bundle").agg(F.array_sort(F.collect_list(F.struct("code", "id"))).alias("x")).join(n, ["g", "bundle"]) \
        .select("g", "bundle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"),
                F.col("x.code").alias("code"), F.col("x.id").alias("id"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if right.num_rows:
            code, ids = (right.column(c)[0].values.to_numpy() for c in ("code", "id"))
            for unit, asked_for in zip(left.column("unit").to_pylist(), left.column("codes").to_pylist(), strict=True):
                own = np.cumsum(unpacked(asked_for, "<i8"))
                at = np.minimum(np.searchsorted(code, own), len(code) - 1)
                hit = code[at] == own
                if hit.any():
                    out.append((unit, packed(np.diff(own[hit], prepend=0)), packed(ids[at[hit]])))
        unit, code, ids = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"unit": pa.array(unit, pa.int64()), "codes": pa.array(code, pa.binary()), "ids": pa.array(ids, pa.binary())})

    by = ("g", "bundle", "slice")
    return asked.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(run, "unit bigint, codes binary, ids binary")


def paired(seqs: DataFrame, replies: DataFrame) -> DataFrame:
    """Units with each word replaced by the id of the frequent pair that starts
    there; -1 where none does."""
    all_of = replies.groupBy("unit").agg(F.collect_list(F.struct("codes", "ids")).alias("replies"))
    both = seqs.join(all_of, "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for body, replies in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                seq = unpacked(body, "<i8")
                code = np.concatenate([np.cumsum(unpacked(r["codes"], "<i8")) for r in replies])
                ids = np.concatenate([unpacked(r["ids"], "<i8") for r in replies])
                order = np.argsort(code)
                code, ids = code[order], ids[order]
                a, c = seq[:-1], seq[1:]
                own = np.where((a > 0) & (c > 0), (a << np.int64(32)) | c, np.int64(-1))
                at = np.minimum(np.searchsorted(code, own), len(code) - 1)
                out.append(packed(np.where(code[at] == own, ids[at], np.int64(-1))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["unit", "g", "body"])

    return both.select("unit", "g", "body", "replies").mapInArrow(run, SEQ_SCHEMA)


# ---------------------------------------------------------------- phrases


def bundle_numbers(totals: DataFrame) -> DataFrame:
    return totals.select("g", F.expr(f"cast(total div {BUNDLE_PAIRS} + 1 as bigint)").alias("bundles"))


def phrases(df: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST,
            unit_words: int = UNIT_WORDS) -> DataFrame:
    """Every phrase of two or three words with at least ``least`` occurrences:
    ``g``, ``phrase``, ``size``, ``a`` and the frequencies of the parts of its
    cuts (``l1``, ``r1`` after the first word, ``l2``, ``r2`` after the second),
    ``n`` (words of the group) and ``covered``, the largest ``a`` of a longer
    candidate that holds it (null: none)."""
    parts = C.written(units(df, text, group, unit_words), "units", BLOCK_BYTES)
    ranked, totals = word_ranks(parts, least)
    ranked = C.written(ranked, "ranked-words")
    numbers = bundle_numbers(totals)
    seqs = C.written(encoded(parts, ranked), "word-ids", BLOCK_BYTES)
    pair_counts = unit_counts(seqs, numbers, "pair-counts")
    pairs = C.written(ranked_codes(tiled(pair_counts, least, "pairs"), "pair-ranks"), "ranked-pairs")
    seqs2 = C.written(paired(seqs, answers(pair_counts, pairs)), "pair-ids", BLOCK_BYTES)
    triples = as_rows(tiled(unit_counts(seqs2, numbers, "triple-counts"), least, "triples"))

    first, second = F.shiftright("code", 32), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))
    word = lambda c: ranked.select("g", F.col("id").alias(c), F.col("word").alias(f"{c}_word"), F.col("f").alias(f"{c}_f"))
    two = C.written(pairs.select("g", "id", "f", first.alias("w1"), second.alias("w2")).join(word("w1"), ["g", "w1"])
                    .join(word("w2"), ["g", "w2"]), "pair-words")
    side = lambda c: two.select("g", F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("f", "w1_word", "w1_f", "w2_word", "w2_f")])
    three = triples.select("g", "f", first.alias("p"), second.alias("q")).join(side("p"), ["g", "p"]).join(side("q"), ["g", "q"])
    three = C.written(three, "triple-words")
    over = three.select("g", F.explode(F.array_distinct(F.array("p", "q"))).alias("id"), "f").groupBy("g", "id").agg(F.max("f").alias("covered"))
    none = F.lit(None).cast("bigint")
    x2 = two.join(over, ["g", "id"], "left").select(
        "g", F.concat_ws(" ", "w1_word", "w2_word").alias("phrase"), F.lit(2).alias("size"), F.col("f").alias("a"),
        F.col("w1_f").alias("l1"), F.col("w2_f").alias("r1"), none.alias("l2"), none.alias("r2"), "covered")
    x3 = three.select(
        "g", F.concat_ws(" ", "p_w1_word", "p_w2_word", "q_w2_word").alias("phrase"), F.lit(3).alias("size"), F.col("f").alias("a"),
        F.col("p_w1_f").alias("l1"), F.col("q_f").alias("r1"), F.col("p_f").alias("l2"), F.col("q_w2_f").alias("r2"), none.alias("covered"))
    return x2.unionByName(x3).join(totals.withColumnRenamed("total", "n"), "g")


def collocations(found: DataFrame, top: int, percent: int = COVERED_PERCENT, scale: int = SCALE) -> DataFrame:
    """The best ``top`` of each group: ``g``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``. The cut with
    the lowest score counts; phrases that a longer one covers by ``percent`` are left out."""
    wide = lambda c: F.col(c).cast("decimal(18,0)")

    def score(k: int) -> str:
        return f"cast((aa * {scale}) div (cast(l{k} as decimal(18,0)) * cast(r{k} as decimal(18,0))) as bigint)"

    x = found.where(f"covered is null or 100 * covered < {percent} * a").withColumn("aa", wide("a") * wide("a"))
    x = x.withColumn("s1", F.expr(score(1))).withColumn("s2", F.expr(score(2)))
    late = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    x = x.select("g", "phrase", "a", "n", *[F.when(late, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(d)
                                             for c, d in (("l", "l"), ("r", "r"), ("s", "score"))])
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # Best of each slice first, so no task orders all phrases of a group.
    sliced = x.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64))) \
        .withColumn("i", F.row_number().over(Window.partitionBy("g", "slice").orderBy(*best))).where(F.col("i") <= top)
    return sliced.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*best)).cast("bigint")) \
        .where(F.col("rank") <= top).select("g", "rank", "phrase", "a", "l", "r", "n", "score")
