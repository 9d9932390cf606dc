"""Exact top-k inner products with a pivot-distance index.

Inner products become distances: a candidate x gets one more coordinate,
sqrt(M - |x|^2) with M the largest squared norm, a query q gets 0, and then
|q' - x'|^2 = |q|^2 + M - 2 q.x. Every candidate is keyed by its nearest pivot
and its distance to it; equal steps of distance make annuli, and an annulus
is stored as blocks of about ``BLOCK_ROWS`` vectors, so a crowd of equal
vectors is many blocks, not one. Queries are held in blocks too.

A first round scores, for each query block, the one block of its own pivot
that lies nearest, which bounds each query's k-th distance t. By the triangle
inequality a vector at distance r from pivot p is at least |d(q, p) - r| away,
so the second round joins a query block only with the annuli that come within
t of it, sorted by that gap; each task keeps its running k-th scores, lets
them shrink t, and skips what lies beyond. Scores are exact integers.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part; vectors of different length never meet; rows with the
query's own id are no candidates for it; repeated candidate rows count once
per distinct vector; each distinct vector of a query's id is a query with ranks
of its own (``query_hash`` tells them apart); equal scores are ordered by the
smaller id; an empty table gives an empty result; other columns are neither
read nor returned. Vectors too long for 64-bit arithmetic (squared norm of 2**61
or more after scaling) are scored in whole numbers of any size, block against
block: their ranks are exact, and a score beyond 64 bits is null.
"""

from __future__ import annotations

import heapq
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.llm.common import written

BLOCK_ROWS = 1024
QUERY_ROWS = 256
PIVOTS = 32
SLACK = 1e-6
#: Squared norm from which vectors are scored without the index.
WIDE = 2.0 ** 61


def scaled(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """``id``, ``dim``, ``v`` (floor of scale times each component), its squared
    norm and its hash, for the vectors that take part. Vectors too long for
    64 bits have no ``v`` and keep their components in ``wide``."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    short = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) < WIDE / scale / scale
    whole = F.when(short, F.transform(v, lambda x: F.floor(x * scale).cast("bigint")))
    x = df.where(F.coalesce(fine, F.lit(False))).select(
        F.col(key).cast("bigint").alias("id"), F.size(v).alias("dim"), whole.alias("v"), F.when(~short, v).alias("wide"))
    return x.select("*", F.aggregate("v", F.lit(0).cast("bigint"), lambda a, b: a + b * b).alias("norm2"),
                    F.xxhash64("v", "wide").alias("hash")).distinct()


def lifted(rows: np.ndarray, m: int, as_query: bool) -> np.ndarray:
    """Vectors with the coordinate that turns inner products into distances."""
    rows = rows.astype(np.float64)
    last = np.zeros(len(rows)) if as_query else np.sqrt(np.maximum(m - (rows * rows).sum(axis=1), 0.0))
    return np.column_stack([rows, last])


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (rows * rows).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(d2, 0.0))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def keyed(rows: DataFrame, pivots: np.ndarray, m: int, dim: int, as_query: bool) -> DataFrame:
    """``id``, ``hash``, ``v``, nearest ``pivot`` and ``dist`` to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = distances(lifted(matrix(b.column(2), dim), m, as_query), pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])],
                    ["id", "hash", "v", "pivot", "dist"])

    return rows.select("id", "hash", "v").mapInArrow(run, "id bigint, hash bigint, v array<bigint>, pivot int, dist double")


def blocks(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Rows of each group ``by`` packed into blocks of about ``limit``; ids go with their hashes."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("_parts"))
    x = rows.join(counts, by).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("_parts")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        d = t.column("dist").to_numpy()
        v = np.array(t.column("v").to_pylist(), dtype="<i4")
        one = {c: [t.column(c)[0].as_py()] for c in [*by, "part"]}
        return pa.table({**{c: pa.array(x, pa.int32()) for c, x in one.items()}, "lo": [float(d.min())], "hi": [float(d.max())],
                         "n": pa.array([len(d)], pa.int32()), "ids": pa.array([np.column_stack([t.column("id").to_numpy(), t.column("hash").to_numpy()]).astype("<i8").tobytes()], pa.binary()),
                         "vectors": pa.array([v.tobytes()], pa.binary())})

    names = ", ".join(f"{c} int" for c in [*by, "part"])
    return x.groupBy(*by, "part").applyInArrow(pack, f"{names}, lo double, hi double, n int, ids binary, vectors binary")


class Best:
    """Running top-k of the queries of one block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.hashes, self.rows, self.k = ids[:, 0], ids[:, 1], rows, k
        self.norm2 = (rows.astype(np.float64) ** 2).sum(axis=1)
        self.floor = floor.astype(np.float64).copy()  # a score below it is not among the k best
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in ids]

    def reach(self, m: int) -> np.ndarray:
        """Distance of the k-th best so far."""
        d2 = self.norm2 + m - 2 * self.floor
        return np.where(np.isfinite(self.floor), np.sqrt(np.maximum(d2, 0)) + SLACK * (1 + np.sqrt(self.norm2 + m)), np.inf)

    def meet(self, who: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        q = self.rows[who]
        top = float(np.abs(q).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
        if top < 2 ** 53:
            s = (q.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
        else:
            s = q.astype(np.int64) @ rows.astype(np.int64).T
        good = (s >= self.floor[who][:, None]) & (self.ids[who][:, None] != ids[None, :, 0])
        for i in np.flatnonzero(good.any(axis=1)):
            j = np.flatnonzero(good[i])
            if len(j) > self.k:
                cut = np.partition(s[i, j], len(j) - self.k)[len(j) - self.k]
                j = j[s[i, j] >= cut]
            w = who[i]
            got = {*self.found[w], *zip((-s[i, j]).tolist(), ids[j, 0].tolist(), ids[j, 1].tolist(), strict=True)}
            self.found[w] = sorted(got)[:self.k]
            if len(self.found[w]) == self.k:
                self.floor[w] = max(self.floor[w], -self.found[w][-1][0])

    def rows_out(self) -> Iterator[tuple[int, int, int, int, int]]:
        for q, h, got in zip(self.ids.tolist(), self.hashes.tolist(), self.found, strict=True):
            for s, x, y in got:
                yield q, h, x, y, -s


def unpack(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, dtype="<i8").reshape(-1, 2)
    return i, np.frombuffer(vectors, dtype="<i4").reshape(len(i), -1)


def scored(pairs: DataFrame, m: int, k: int, with_rows: bool) -> DataFrame:
    """Score pairs of a query block and a candidate block (``q_*`` and plain
    columns, ``gap`` ascending per query block). ``with_rows``: the best rows;
    else each query's k-th score, as its new floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now, out = None, None, []

        def flush():
            if best is not None and with_rows:
                out.extend(best.rows_out())
            elif best is not None:
                nothing = [0] * len(best.ids)
                out.extend(zip(best.ids.tolist(), best.hashes.tolist(), nothing, nothing, best.floor.tolist(), strict=True))

        for b in batches:
            for qid, q_ids, q_vectors, q_floor, q_dist, lo, hi, ids, vectors in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if qid != now:
                    flush()
                    best, now = Best(*unpack(q_ids, q_vectors), np.frombuffer(q_floor, dtype="<f8"), k), qid
                d = np.frombuffer(q_dist, dtype="<f8")
                gap = np.maximum(np.maximum(lo - d, d - hi), 0)
                who = np.flatnonzero(gap <= best.reach(m))
                if len(who):
                    best.meet(who, *unpack(ids, vectors))
        flush()
        if out:
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([x[i] for x in out], pa.int64()) for i in range(4)],
                 pa.array([x[4] for x in out], pa.int64() if with_rows else pa.float64())],
                ["query_id", "query_hash", "vec_id", "hash", "score"])

    kind = "bigint" if with_rows else "double"
    x = pairs.select("qid", "q_ids", "q_vectors", "q_floor", "q_dist", "lo", "hi", "ids", "vectors")
    return x.mapInArrow(run, f"query_id bigint, query_hash bigint, vec_id bigint, hash bigint, score {kind}")


def reachable(queries: DataFrame, pivots: np.ndarray, m: int) -> DataFrame:
    """Per query block and pivot: the distances of its queries, and the range
    of distances that their bounds reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qid, ids, vectors, floor in zip(*(c.to_pylist() for c in b.columns), strict=True):
                best = Best(*unpack(ids, vectors), np.frombuffer(floor, dtype="<f8"), 1)
                d, t = distances(lifted(best.rows, m, True), pivots), best.reach(m)
                n = len(pivots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qid] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array((d - t[:, None]).min(axis=0)),
                     pa.array((d + t[:, None]).max(axis=0)), pa.array(d.mean(axis=0)),
                     pa.array([d[:, p].astype("<f8").tobytes() for p in range(n)], pa.binary()),
                     pa.array([ids] * n, pa.binary()), pa.array([vectors] * n, pa.binary()), pa.array([floor] * n, pa.binary())],
                    ["qid", "pivot", "from_", "to_", "middle", "q_dist", "q_ids", "q_vectors", "q_floor"])

    return queries.select("qid", "ids", "vectors", "floor").mapInArrow(
        run, "qid bigint, pivot int, from_ double, to_ double, middle double, q_dist binary, q_ids binary, q_vectors binary, q_floor binary")


def one_length(rows: DataFrame, queries: Column, dim: int, k: int) -> DataFrame:
    """``query_id``, ``query_hash``, ``vec_id``, ``hash``, ``score`` of the best rows, for one length."""
    rows = rows.where((F.col("dim") == dim) & F.col("v").isNotNull())
    stats = rows.agg(F.max("norm2").alias("m"), F.count(F.lit(1)).alias("n")).first()
    m, n = int(stats["m"]), int(stats["n"])
    # Pivots: a bounded sample of the vectors, in the order of their hash.
    sample = rows.select("v").orderBy(F.xxhash64("v"), "id").limit(PIVOTS).collect()
    pivots = np.unique(lifted(np.array([r["v"] for r in sample], dtype=np.int64), m, False), axis=0)
    points = keyed(rows, pivots, m, dim, False)
    # Annuli of equal width: about one block each, were the distances spread evenly.
    rings = max(1, n // (len(pivots) * BLOCK_ROWS))
    far = points.agg(F.max("dist")).first()[0] or 1.0
    points = points.withColumn("ring", F.least(F.floor(F.col("dist") / F.lit(far / rings)), F.lit(rings - 1)).cast("int"))
    index = written(blocks(points, ["pivot", "ring"], BLOCK_ROWS), "pivot-index")
    asked = keyed(rows.where(queries), pivots, m, dim, True)
    q = blocks(asked, ["pivot"], QUERY_ROWS).withColumn("qid", F.col("pivot").cast("bigint") * (1 << 32) + F.col("part"))
    q = written(q.withColumn("floor", F.expr("CAST(NULL AS BINARY)")), "queries")
    q0 = with_floor(q, None)
    # Round 1: per query block the block of its pivot that lies nearest (metadata first, then its vectors).
    own = reachable(q0, pivots, m).where(F.col("pivot") == F.shiftright("qid", 32).cast("int"))
    meta = index.select(F.col("pivot").alias("p"), "ring", "part", "lo", "hi", "n")
    gap = F.greatest(F.col("lo") - F.col("middle"), F.col("middle") - F.col("hi"), F.lit(0.0))
    first = own.select("qid", "pivot", "middle").join(meta, F.col("pivot") == F.col("p")) \
        .groupBy("qid").agg(F.min_by(F.struct("p", "ring", "part"), F.struct(F.col("n") <= k, gap, "ring", "part")).alias("b")) \
        .select("qid", F.col("b.p").alias("pivot"), F.col("b.ring").alias("ring"), F.col("b.part").alias("part"))
    near = own.join(first, ["qid", "pivot"]).join(index, ["pivot", "ring", "part"])
    floors = scored(near, m, k, False).select("query_id", "query_hash", F.col("score").alias("floor_of"))
    # Round 2: the annuli within reach, nearest first.
    q1 = written(with_floor(q, floors), "queries")
    within = reachable(q1, pivots, m)
    pairs = within.join(index, "pivot").where((F.col("lo") <= F.col("to_")) & (F.col("hi") >= F.col("from_")))
    pairs = pairs.withColumn("gap", gap).sortWithinPartitions("qid", "gap")
    return scored(pairs, m, k, True)


def with_floor(q: DataFrame, floors: DataFrame | None) -> DataFrame:
    """Query blocks with the k-th score known of each query (-inf: none)."""
    if floors is None:
        def none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = [len(x) // 16 for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([np.full(x, -np.inf, dtype="<f8").tobytes() for x in n], pa.binary())],
                    ["qid", "ids", "vectors", "floor"])
        return q.select("qid", "ids", "vectors").mapInArrow(none, "qid bigint, ids binary, vectors binary, floor binary")

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qid, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                i = np.frombuffer(ids, dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qid] * len(i), pa.int64()), pa.array(np.arange(len(i), dtype=np.int32)), pa.array(i[:, 0]), pa.array(i[:, 1])],
                    ["qid", "at", "query_id", "query_hash"])

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("ids")[0].as_py()
        floor = np.full(len(ids) // 16, -np.inf, dtype="<f8")
        floor[right.column("at").to_numpy()] = right.column("floor_of").to_numpy()
        return pa.table({"qid": left.column("qid").slice(0, 1), "ids": pa.array([ids], pa.binary()),
                         "vectors": left.column("vectors").slice(0, 1), "floor": pa.array([floor.tobytes()], pa.binary())})

    known = floors.groupBy("query_id", "query_hash").agg(F.min("floor_of").alias("floor_of"))
    spread = q.select("qid", "ids").mapInArrow(ids_of, "qid bigint, at int, query_id bigint, query_hash bigint") \
        .join(known, ["query_id", "query_hash"])
    return q.select("qid", "ids", "vectors").groupBy("qid").cogroup(spread.groupBy("qid")) \
        .applyInArrow(put, "qid bigint, ids binary, vectors binary, floor binary")


def wide_pairs(rows: DataFrame, queries: Column, k: int, scale: int) -> DataFrame:
    """The best rows of all pairs with a vector that 64 bits can't score, their
    scores as decimal texts: blocks of one side meet blocks of the other."""
    x = rows.select("id", "hash", "dim", F.coalesce("wide", F.transform("v", lambda c: c / scale)).alias("x"),
                    F.col("wide").isNotNull().alias("is_wide"), F.coalesce(queries, F.lit(False)).alias("asks"))
    # Whole components below 2**31 are exact in doubles, also divided by a power of two.
    n = x.groupBy("dim", "is_wide").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("n"))
    x = x.join(n, ["dim", "is_wide"]).withColumn("part", F.pmod(F.xxhash64("id", "hash"), F.col("n")).cast("int"))
    block = F.collect_list(F.struct("id", "hash", "x"))
    those = x.groupBy("dim", "is_wide", "part").agg(block.alias("rows"))
    asked = x.where("asks").groupBy("dim", F.col("is_wide").alias("wide_query"), F.col("part").alias("q")).agg(block.alias("asked"))
    # Each block of queries goes to every block that it has to meet, one task each.
    to = asked.join(n, "dim").where("wide_query OR is_wide") \
        .select("dim", "is_wide", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), "asked")

    def whole(v: list[float]) -> list[int]:
        return [math.floor(c * scale) if abs(c) < 2.0 ** 60 else int(c) * scale for c in v]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asked, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                right, out = [(r["id"], r["hash"], whole(r["x"])) for r in rows], []
                for q in asked:
                    own = whole(q["x"])
                    got = ((sum(map(operator.mul, own, v)), -i, h) for i, h, v in right if i != q["id"])
                    out += [(q["id"], q["hash"], -i, h, str(s)) for s, i, h in heapq.nlargest(k, got)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 5, fields, strict=True)], schema=fields)

    fields = pa.schema([*[(c, pa.int64()) for c in ("query_id", "query_hash", "vec_id", "hash")], ("exact", pa.string())])
    return to.join(those, ["dim", "is_wide", "part"]).select("asked", "rows") \
        .mapInArrow(run, "query_id bigint, query_hash bigint, vec_id bigint, hash bigint, exact string")


def sort_text(number: Column) -> Column:
    """A text whose order is that of whole numbers given as decimal texts."""
    digits = F.ltrim(number, F.lit("-"))
    return F.when(number.startswith("-"), F.concat(F.lit("0"), F.lpad((9999 - F.length(digits)).cast("string"), 4, "0"),
                                                    F.translate(digits, "0123456789", "9876543210"))) \
        .otherwise(F.concat(F.lit("1"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits))


def top_k(df: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
          scale: int = 256) -> DataFrame:
    """For every row with ``queries`` (a condition on ``id``): ``query_id``,
    ``rank`` (from 1), ``vec_id``, ``score`` of the k best other rows, and
    ``query_hash`` of the query's vector."""
    rows = written(scaled(df, key, vector, scale), "vectors")
    short = F.col("v").isNotNull()
    kinds = rows.groupBy("dim").agg(F.count_if(F.coalesce(queries, F.lit(False)) & short).alias("asked"),
                                    F.count_if(~short).alias("wide")).orderBy("dim").collect()
    got = rows.limit(0).select(*[F.col("id").alias(c) for c in ("query_id", "query_hash", "vec_id", "hash", "score")])
    for d in kinds:
        if d["asked"]:
            got = got.unionByName(one_length(rows, queries, d["dim"], k))
    order = [F.desc("score"), "vec_id"]
    if any(d["wide"] for d in kinds):
        got = got.withColumn("exact", F.col("score").cast("string")).drop("score").unionByName(wide_pairs(rows, queries, k, scale)) \
            .withColumn("score", F.expr("try_cast(exact AS bigint)")).withColumn("place", sort_text(F.col("exact")))
        order = [F.desc("place"), "vec_id"]
    got = got.distinct()
    best = Window.partitionBy("query_id", "query_hash").orderBy(*order)
    return got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score", "query_hash")
