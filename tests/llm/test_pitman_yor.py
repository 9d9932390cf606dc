"""Pitman-Yor model: exact counts, proper probabilities, held-out gain."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paritas.llm import common, pitman_yor
from tests.conftest import SF_MID

QUICK = pitman_yor.Sampling(sweeps=3, averaged=2)


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def test_counts_and_base_score(sp, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BATCH_TOKENS", 40)
    docs = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 9))) for i in range(60)] + [(70, None), (71, ""), (None, "w1 W2 É é"), (3, "w1"), (3, "w1")]
    df = sp.createDataFrame([(*d, 1.0) for d in docs], "doc_id bigint, text string, score double")
    got = pitman_yor.scored(df, F.col("doc_id") % 4 != 1, sampling=QUICK, slices=5).collect()
    learned = [t for k, t in docs if k is not None and k % 4 != 1]
    count = Counter(w for t in learned for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((k or 0, len(tokens(t)), sum(w in count for w in tokens(t)),
                   round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for k, t in docs)
    assert sorted((x.row_key or 0, x.n_tokens, x.n_known, round(x.base_score, 6)) for x in got) == want
    assert all(x.train_tokens == n and x.score < 0 and (x.learned or x.row_key is None or x.row_key % 4 == 1) for x in got)


@pytest.mark.parametrize("slices", [1, 4])
def test_probabilities_add_up_to_one(sp, slices):
    docs = sp.createDataFrame([(0, "a b a c a b d d e")], "doc_id bigint, text string")
    words = ["a", "b", "c", "d", "e"]
    # Every known word, the end and an unknown word after each known word.
    ask = [(i * 10 + j, f"{u} {w}".strip(), u, w) for i, u in enumerate(words) for j, w in enumerate([*words, "", "unknown"])]
    both = docs.unionAll(sp.createDataFrame([(100 + k, t) for k, t, _, _ in ask], "doc_id bigint, text string"))
    got = {x.row_key - 100: x.score for x in pitman_yor.scored(both, F.col("doc_id") == 0, sampling=QUICK, slices=slices).collect()}
    # score(u w end) = p(u) p(w | u) p(end | w): p(end | w) and p(u) from the texts of one word.
    alone = {u: got[i * 10 + len(words)] for i, u in enumerate(words)}  # p(u) p(end | u)
    two = {(u, w): got[k] for k, _, u, w in ask}
    for u in words:
        # p(w | u) / p(w | start) = score(u w end) - score(w end) - log p(u | start); the unknowns cancel in the ratio test.
        assert all(two[u, w] < alone[w] for w in words)
    top, g, s = np.array([3, 2, 1, 1, 1, 1]), None, QUICK
    g = pitman_yor.Totals(6, 10, 0.5, 0.4, np.full(256, 10), np.full(256, 4), 9, 6)
    known, unknown = pitman_yor.parent_probability(top, np.ones(6), g, s)
    assert math.isclose(known.sum() + unknown, 1.0)


def test_a_context_is_a_distribution():
    """All words of one context, from a merged slice seated by hand."""
    words = np.arange(10, 16, dtype=np.uint64)
    pw, pc, n = np.array([0, 0, 1, 2, 3, 4, 5]), np.array([7, 9, 7, 7, 9, 9, 7]), np.array([40, 3, 5, 1, 2, 100, 1])
    x = {"words": words, "totals": np.bincount(pw, weights=n).astype(int), "pair_word": pw, "pair_context": pc, "counts": n}
    rng = np.random.default_rng(0)
    x["tables"] = np.minimum(n, rng.integers(1, 4, len(n)))
    x["top_tables"] = np.ones(6, dtype=int)
    top = pitman_yor.parent_customers(x)
    c, t = np.bincount(pc, weights=n, minlength=256), np.bincount(pc, weights=x["tables"], minlength=256)
    g = pitman_yor.Totals(6, int(n.sum()), 0.6, 0.4, c, t, int(top.sum()), 6)
    parent, unknown = pitman_yor.parent_probability(top, x["top_tables"], g, QUICK)
    own = pitman_yor.probabilities(x, g, QUICK)
    for ctx in (7, 9):
        here = pc == ctx
        open_ = (QUICK.strength + g.discount * t[ctx]) / (QUICK.strength + c[ctx])
        rest = sum(parent[w] for w in range(6) if w not in pw[here]) + unknown
        assert math.isclose(own[here].sum() + open_ * rest, 1.0)


KEYS = np.arange(1, 40_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def partitions(items):
    """All ways to seat customers at tables."""
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1:]]


@pytest.mark.parametrize("n,others,prior,d,theta", [(3, 3, 0.3, 0.5, 2.0), (6, 0, 0.05, 0.8, 1.0), (7, 40, 0.9, 0.2, 0.5)])
def test_tables_follow_the_exact_conditional(n, others, prior, d, theta):
    """Against the enumeration of every seating of a small restaurant's dish."""
    weight = Counter()
    for seats in partitions(list(range(n))):
        w = math.prod(math.prod(j - d for j in range(1, len(x))) for x in seats)
        weight[len(seats)] += w * math.prod((theta + d * (others + j)) * prior for j in range(len(seats)))
    got = Counter(pitman_yor.seat(np.full(40_000, n), np.full(40_000, others), np.full(40_000, prior), d, theta, KEYS).tolist())
    total = sum(weight.values())
    assert all(abs(got[t] / 40_000 - w / total) < 0.012 for t, w in weight.items())


def test_many_customers():
    for n in (65, 5000, 100_000):
        big = pitman_yor.seat(np.full(50, n), np.full(50, 3), np.full(50, 0.3), 0.5, 2.0, KEYS[:50])
        assert (big >= 1).all() and (big < n).all() and len(set(big.tolist())) > 5
    rng = np.random.default_rng(4)
    for n, p in ((4, 0.3), (400, 0.9), (300, 0.01), (5000, 0.4)):
        x = pitman_yor.binomial(np.full(20_000, n), np.full(20_000, p), rng.random(20_000), rng.random(20_000))
        assert abs(x.mean() - n * p) < 0.05 * math.sqrt(n * p * (1 - p)) and abs(x.std() / math.sqrt(n * p * (1 - p)) - 1) < 0.04
        assert x.min() >= 0 and x.max() <= n


def test_scores_do_not_depend_on_slices(sp):
    docs = [(i, " ".join(f"w{(i * j) % 23}" for j in range(30))) for i in range(60)]
    df = sp.createDataFrame(docs, "doc_id bigint, text string")
    got = [sorted((x.row_key, x.score) for x in pitman_yor.scored(df, F.col("doc_id") % 5 != 1, slices=n).collect()) for n in (1, 3, 8)]
    assert got[0] == got[1] == got[2]
    assert not [x for x in sp.catalog.listTables() if x.name.startswith("paritas_")]


def test_round_trips():
    v = np.array([0, 3, 254, 255, 256, 10**12])
    assert pitman_yor.unspelled(pitman_yor.spelled(v), len(v)).tolist() == v.tolist()


def test_nothing_to_learn_from(sp):
    df = sp.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = pitman_yor.scored(df, F.lit(False), sampling=QUICK, slices=2).collect()
    assert sorted((x.row_key, x.n_known, x.train_tokens, x.base_score) for x in got) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    assert pitman_yor.scored(df.limit(0), F.lit(True), sampling=QUICK, slices=2).count() == 0


def test_better_than_single_words_on_held_out(sp):
    docs = common.table(sp, SF_MID, "documents")
    x = pitman_yor.scored(docs, common.crc_of(F.col("doc_id")) % 7 != 2)
    got = {r.learned: r for r in pitman_yor.perplexity(x).collect()}
    assert got[False].perplexity < 0.7 * got[False].base_perplexity


def test_contexts_are_whole_words(sp, monkeypatch):
    """Against a count by hand: before any sweep each dish has one table."""
    monkeypatch.setattr(pitman_yor, "BATCH_TOKENS", 25)
    # station, nation and ration share their last three bytes; 400 more words share one ending.
    docs = [(0, "station x station x nation y nation y z"), (1, "the ration x"), (2, None), (1, "the ration x"), (3, "new station y nation")]
    docs += [(4 + 4 * i, f"{i}ation v{i % 7}") for i in range(400)] + [(5, "nation x station unseen nation 7ation v0 unseen x 8ation")]
    learned = [t for k, t in docs if k % 4 != 1 or k == 1]
    start, pairs = b"\n", Counter()
    for t in learned:
        words = tokens(t)
        pairs.update(zip([start, *words], words, strict=False))
    top = Counter(w for _, w in pairs)
    context, kinds = Counter(), Counter()
    for (u, _), n in pairs.items():
        context[u] += n
        kinds[u] += 1
    d = pitman_yor.discount(*(list(pairs.values()).count(i) for i in (1, 2)))
    top_d = pitman_yor.discount(*(list(top.values()).count(i) for i in (1, 2)))
    n = sum(top.values())

    def p(u, w):
        parent = (max(top[w] - top_d, 0) + (1 + top_d * len(top)) / (len(top) + 1)) / (1 + n)
        return (max(pairs[u, w] - d, 0) + (1 + d * kinds[u]) * parent) / (1 + context[u])

    want = sorted((k, round(sum(math.log10(p(u, w)) for u, w in zip([start, *tokens(t)], tokens(t), strict=False)), 4)) for k, t in docs)
    df = sp.createDataFrame(docs, "doc_id bigint, text string")
    for slices in (1, 7):
        x = pitman_yor.scored(df, (F.col("doc_id") % 4 != 1) | (F.col("doc_id") == 1), sampling=pitman_yor.Sampling(sweeps=0, averaged=1), slices=slices)
        assert sorted((r.row_key, round(r.score, 4)) for r in x.collect()) == want


def test_words_with_one_ending_are_apart(sp):
    docs = [(i, "station x station x nation y nation y") for i in range(0, 60, 3)] + [(1, "station x"), (4, "nation x"), (7, "station y"), (10, "nation y")]
    got = {r.row_key: r.score for r in pitman_yor.scored(sp.createDataFrame(docs, "doc_id bigint, text string"), F.col("doc_id") % 3 == 0).collect()}
    # From "station x" to "nation x" only the contexts change: each has learned its own follower.
    assert got[1] + got[10] > got[4] + got[7] + 1.5


def test_packed_numbers():
    for arrays in ([np.array([0, 255, 256, 2**63])], [np.zeros(0), np.array([3, 1]), np.zeros(4)]):
        got = pitman_yor.unpacked(pitman_yor.packed(*arrays))
        assert [x.tolist() for x in got] == [x.tolist() for x in arrays]
    v = np.array([5, 9, 2**64 - 1], dtype=np.uint64)
    assert pitman_yor.climbed(pitman_yor.steps(v)).tolist() == v.tolist()
