"""Budgets against recursive sharing, prefixes against a plain walk."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paritas.llm import mixing

LEVELS = ["domain", "lang", "source"]


def shares(budget, nodes):
    """nodes: {name: (weight, capacity)}; round by round, as one would by hand."""
    some = any(x > 0 for x, _ in nodes.values())
    live = {k: v for k, v in nodes.items() if v[0] > 0 or not some}
    got = {k: 0 for k in nodes if k not in live}
    while live:
        w = sum(max(x, 0) for x, _ in live.values())
        rate = {k: (max(x, 0) / w if w else 1 / len(live)) * budget for k, (x, _) in live.items()}
        full = [k for k, (_, c) in live.items() if rate[k] >= c]
        if not full:
            return got | rate
        for k in full:
            got[k] = live.pop(k)[1]
            budget -= got[k]
    return got


def children(leaves, prefix):
    return sorted({k[len(prefix)] for k in leaves if k[:len(prefix)] == prefix})


def capacity(leaves, weights, epochs, prefix):
    if len(prefix) == 3:
        return epochs * leaves[prefix]
    kids = {n: weights.get("/".join((*prefix, n)), 1.0) for n in children(leaves, prefix)}
    return sum(capacity(leaves, weights, epochs, (*prefix, n)) for n, w in kids.items() if w > 0 or max(kids.values()) <= 0)


def budgets(leaves, weights, total, epochs, prefix=()):
    nodes = {n: (weights.get("/".join((*prefix, n)), 1.0), capacity(leaves, weights, epochs, (*prefix, n))) for n in children(leaves, prefix)}
    out = {}
    for n, b in shares(total, nodes).items():
        out |= {(*prefix, n): b} if len(prefix) == 2 else budgets(leaves, weights, b, epochs, (*prefix, n))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets(sp, seed):
    r = random.Random(seed)
    leaves = {(f"d{r.randrange(3)}", f"l{r.randrange(3)}", f"s{i}"): r.choice([0, 10, 100, 1000]) for i in range(14)}
    weights = {p: r.choice([0.0, 1.0, 3.0, 0.5]) for k in leaves for p in (k[0], "/".join(k[:2]), "/".join(k)) if r.random() < 0.7}
    total = r.choice([50, 700, 3000, 10**6])
    df = sp.createDataFrame([(*k, t, 1) for k, t in leaves.items()], "domain string, lang string, source string, tokens bigint, docs bigint")
    w = sp.createDataFrame([*weights.items(), ("nowhere", 5.0)], "path string, weight double")
    got = {(x.domain, x.lang, x.source): x.budget for x in mixing.budgets(df, w, LEVELS, total, 2).collect()}
    want = budgets(leaves, weights, total, 2)
    assert got.keys() == leaves.keys() and all(abs(got[k] - want[k]) <= 1 for k in leaves)


def test_prefixes_over_slices(sp, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_DOCS", 10)
    r = random.Random(5)
    docs = [(i, "w " * r.randrange(0, 9), "a" if i % 3 else None, "s") for i in range(400)]
    df = sp.createDataFrame(docs, "doc_id bigint, text string, lang string, tokens string")
    levels = {"lang": F.col("lang"), "source": F.col("tokens")}
    w = sp.createDataFrame([("a", 1.0), ("", 4.0)], "path string, weight double")
    got = mixing.mix(df, levels, w, 0.9, 3, 7).collect()
    tokens = {i: t.count("w") for i, t, _, _ in docs}
    by = defaultdict(list)
    for x in got:
        by[x.lang].append(x)
    budget = {k: sum(x.taken_tokens for x in v) for k, v in by.items()}
    total = sum(tokens.values())
    assert abs(sum(budget.values()) - int(total * 0.9)) <= 2
    for lang, rows in by.items():
        ids = [i for i, _, x, _ in docs if x == lang]
        size = sum(tokens[i] for i in ids)
        whole = budget[lang] // size
        want, left = {}, budget[lang] - whole * size
        for i in sorted(ids, key=lambda i: hashlib.md5(f"7:{whole}:{i}".encode()).hexdigest()):
            if left <= 0:
                break
            want[i, whole] = min(tokens[i], left)
            left -= tokens[i]
        want |= {(i, e): tokens[i] for i in ids for e in range(whole)}
        assert {(x.row_key, x.epoch): x.taken_tokens for x in rows} == want
    again = mixing.mixed(df, mixing.mix(df, levels, w, 0.9, 3, 7))
    assert again.columns == df.columns and again.count() == len(got)


def test_edge_cases(sp):
    df = sp.createDataFrame([(1, None, "x", "e"), (2, "", "x", "e"), (None, "a b", "y", None), (4, "a b", "y", None), (4, "a b", "y", None)],
                            "doc_id bigint, text string, source string, epoch string")
    levels = {"source": F.col("source"), "kind": F.col("epoch")}
    w = sp.createDataFrame([("x", 1.0)], "path string, weight double")
    got = mixing.mix(df, levels, w, 5.0, 2, 1).collect()
    assert sorted((x.row_key or 0, x.epoch, x.taken_tokens) for x in got) == [(0, 0, 2), (0, 1, 2), (4, 0, 2), (4, 0, 2), (4, 1, 2), (4, 1, 2)]
    assert mixing.mix(df.limit(0), levels, w, 1.0, 2, 1).count() == 0


def test_any_column_names_stay(sp):
    """Columns called like the operator's own helpers are kept as they are."""
    helpers = ["key", "hash", "row", "row_key", "row_hash", "epoch", "_mix_key", "tokens"]
    rows = [(k, "a b c", "en", *[f"{c}{k}" for c in helpers]) for k in range(4)]
    df = sp.createDataFrame(rows, "doc_id bigint, text string, lang string, " + ", ".join(f"{c} string" for c in helpers))
    weights = sp.createDataFrame([("en", 1.0)], "path string, weight double")
    got = mixing.mixed(df, mixing.mix(df, {"lang": F.col("lang")}, weights, 1.0, 1, 7))
    assert got.dtypes == df.dtypes and sorted(map(tuple, got.collect())) == rows
