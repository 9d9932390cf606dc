"""Pivot-distance index against all pairs."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from paritas.llm import topk


def plain(rows, k, every):
    fine = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
            if i is not None and v and all(x is not None and (isinstance(x, Fraction) or math.isfinite(x)) for x in v)}
    out = []
    for q, qv in fine:
        if q % every == 0:
            got = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in fine if i != q and len(v) == len(qv))
            out += [(q, r, i, -s if -2**63 <= -s < 2**63 else None) for r, (s, i) in enumerate(got[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(x) for x in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.mark.parametrize("block", [7, 1024])
def test_exact(sp, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "PIVOTS", 5)
    r = random.Random(block)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(260)]
    rows += [(i, [0.5, -0.25, 0.125, 1.0, 0.0, -2.0]) for i in range(260, 340)]  # many equal vectors
    rows += [(i, [r.gauss(0, 30)] * 3) for i in range(340, 352)] + [(360, [1.0])]
    rows += [(400, None), (401, []), (402, [1.0, None, 2.0, 1.0, 1.0, 1.0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (None, [1.0] * 6), rows[3]]
    df = sp.createDataFrame([(*x, 1) for x in rows], "vec_id bigint, embedding array<float>, score int")
    rows = [(x.vec_id, x.embedding) for x in df.collect()]
    assert rows_of(topk.top_k(df, F.col("id") % 10 == 0)) == plain(rows, 5, 10)


def test_repeated_ids(sp):
    """Each distinct vector of a query's id has ranks of its own."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0])]
    df = sp.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = topk.top_k(df, F.col("id") == 50)
    assert rows_of(got) == plain(rows, 5, 50) and got.select("query_hash").distinct().count() == 2


def test_large_components(sp):
    """Vectors beyond 64-bit arithmetic are ranked exactly, and none fails the query."""
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    rows += [(100, [1e8, 0.0, 1.0]), (110, [1e17, -1e17, 3.0]), (121, [-1e17, 1.0, 2.0]), (130, [1.7e308, 0.0, 0.0]),
             (131, [-1.7e308, 1.0, 0.0]), (132, [8.4e6, 8.4e6, 8.4e6]), (140, [1e9, 1e9, 1e9]), (141, [1e9, 1e9, 1e9 + 1]), (5, [1e300] * 3)]
    df = sp.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = plain_big(rows, 5, 10)
    assert rows_of(topk.top_k(df, F.col("id") % 10 == 0)) == want and any(x[3] is None for x in want)


def plain_big(rows, k, every):
    """As ``plain``, without rounding 256 * x to a float."""
    return plain([(i, [Fraction(x) for x in v]) for i, v in rows], k, every)


def test_order_of_texts(sp):
    numbers = [0, 5, -5, 10, -10, 99, 100, -99, -100, 10**40, -10**40, 10**40 + 1, 2**63, -2**63 - 1]
    df = sp.createDataFrame([(str(n),) for n in numbers], "n string")
    got = [int(x.n) for x in df.orderBy(topk.sort_text(F.col("n"))).collect()]
    assert got == sorted(numbers)


def test_few_and_none(sp):
    df = sp.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 1.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    got = rows_of(topk.top_k(df, F.col("id") == 0))
    assert got == [(0, 1, 2, 5 * 65536), (0, 2, 1, 2 * 65536)]
    assert topk.top_k(df.limit(0), F.col("id") == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("id") == 0).count() == 0
