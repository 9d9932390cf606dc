"""Jaccard join against all pairs of n-gram sets."""

import random

import pytest

from paritas.llm import jaccard


def plain(docs):
    """doc rows (key, text) -> per row: class id, copy id, links, class links."""
    sets = []
    for _, t in docs:
        w = (t or "").split()
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    n = len(docs)

    def near(a, b):
        return a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b))
    link = [[j for j in range(n) if j != i and near(sets[i], sets[j])] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        for i in range(n):
            group[i] = min([group[i], *(group[j] for j in link[i])])
    least = lambda ids: min((docs[i][0] for i in ids if docs[i][0] is not None), default=None)
    return [(docs[i][0], least(j for j in range(n) if group[j] == group[i]), least(j for j in range(n) if sets[j] == sets[i]), len(link[i]),
             len({sets[j] for j in link[i]} - {sets[i]})) for i in range(n)]


def joined(df):
    return [(r.row_key, r.class_id, r.copy_id, r.n_links, r.n_class_links) for r in jaccard.join(df).collect()]


def order(rows):
    return sorted(rows, key=lambda x: tuple((v is None, v or 0) for v in x))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    docs = []
    for _ in range(14):
        base = [word() for _ in range(r.choice([3, 5, 40, 90, 90]))]
        for _ in range(r.choice([1, 1, 2, 5, 14])):
            own = list(base)
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                own[r.randrange(len(own))] = word()
            docs.append(" ".join(own))
    r.shuffle(docs)
    return [(i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed,block", [(1, 2000), (2, 3)])
def test_all_links(sp, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)  # small blocks: groups span many of them
    docs = corpus(seed)
    got = joined(sp.createDataFrame(docs, "doc_id bigint, text string"))
    want = plain(docs)
    assert sum(x[3] for x in want) > 20 and order(got) == order(want)


def test_edge_cases(sp):
    docs = [(1, "a b"), (2, "a  b\n"), (3, "a b c"), (4, None), (5, ""), (6, " \n "), (7, "x y z u v w"), (7, "x y z u v w"), (None, "x y z u v w"),
            (None, "only one"), (8, "k " * 3000), (9, "k " * 4)]
    df = sp.createDataFrame([(*d, "c", 0) for d in docs], "doc_id bigint, text string, cls string, band int")
    assert order(joined(df)) == order(plain(docs))
    assert jaccard.join(df.limit(0)).count() == 0
    kept = jaccard.one_per_class(df, jaccard.join(df))
    assert kept.columns == df.columns
    assert sorted(x or 0 for x in (r.doc_id for r in kept.collect())) == [0, 1, 3, 4, 7, 8, 9]


def test_classes_that_share_a_key_each_keep_a_row(sp):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(None, "red green blue"), (None, "one two three"), (None, "one  two three"), (None, long), (None, long + " end"), (None, None),
            (5, "sun and moon"), (5, "salt and pepper"), (5, "salt  and pepper"), (5, "sun and moon"), (6, "sun and moon"), (9, "left"), (None, "left")]
    df = sp.createDataFrame([(*d, "c") for d in docs], "doc_id bigint, text string, component string")
    kept = jaccard.one_per_class(df, jaccard.join(df))
    assert kept.columns == df.columns
    got = sorted((r.doc_id or 0, " ".join((r.text or "").split()).removesuffix(" end")) for r in kept.collect())
    assert got == sorted([(0, "red green blue"), (0, "one two three"), (0, long), (0, ""), (5, "sun and moon"), (5, "salt and pepper"), (9, "left")])


def test_banding():
    for threshold, recall in ((0.8, 1 - 1e-6), (0.5, 0.99), (0.9, 0.999)):
        bands, rows = jaccard.banding(threshold, recall)
        assert bands * rows <= jaccard.MOST_HASHES and 1 - (1 - threshold ** rows) ** bands >= recall


def test_components(sp):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)]
    got = {x.node: x.root for x in jaccard.components(sp.createDataFrame(edges, "a int, b int")).collect()}
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def test_any_column_names_stay(sp):
    """Columns called like the operator's own helpers are kept as they are."""
    helpers = ["key", "hash", "row", "kept_key", "kept_hash", "n", "component", "row_key", "_near_n"]
    rows = [(k, t, *[f"{c}{k}" for c in helpers]) for k, t in ((1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words here"))]
    df = sp.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in helpers))
    kept = jaccard.one_per_class(df, jaccard.join(df))
    assert kept.dtypes == df.dtypes and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
