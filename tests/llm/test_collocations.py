"""Phrases and their scores against plain counts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from paritas.llm import collocations as K

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top, least=10, percent=50):
    f, total = Counter(), Counter()
    for g, t in rows:
        g = "und" if g is None else g
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            total[g] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[g, tuple(w[i:i + k])] += 1
    out = []
    for g in total:
        best = []
        for (h, p), a in f.items():
            if h != g or len(p) < 2 or a < least:
                continue
            longer = [n for (j, q), n in f.items() if j == g and n >= least and len(q) == 3 > len(p) and p in (q[:2], q[1:])]
            if any(100 * n >= percent * a for n in longer):
                continue
            cuts = [(1_000_000 * a * a // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            best.append((-s, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
        for i, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1):
            out.append((g, i, p.decode(), -a, x, y, total[g], -s))
    return sorted(out)


def corpus(n, seed):
    rnd = random.Random(seed)
    words = ["the", "The", "a", "of", "New", "york", "Île", "café", "x\x1cy", "nb sp", "😀", "w1", "w2", "w3", "und"]
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(rnd.randrange(30)))
        rows.append((rnd.choice(["en", "en", "fr", None, "und"]), text + rnd.choice(["", " a a a a a ", " New York city; ", "..."])))
    return rows


@pytest.mark.parametrize("unit_words,fan_in", [(K.UNIT_WORDS, K.FAN_IN), (150, 2)])
def test_same_as_plain(sp, monkeypatch, unit_words, fan_in):
    """Also with many small units, whose head tiles are added up in rounds."""
    monkeypatch.setattr(K, "FAN_IN", fan_in)
    rows = corpus(400, 8) + [("en", None), ("fr", ""), ("en", " .;. "), ("xx", "solo")] + [("en", "hot phrase here. hot phrase")] * 60
    df = sp.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, g string, unit int").repartition(4)
    got = sorted(map(tuple, K.collocations(K.phrases(df, unit_words=unit_words), 25).collect()))
    assert got == plain(rows, 25) and {r[0] for r in got} == {"en", "fr", "und"}


def test_empty(sp):
    df = sp.createDataFrame([], "lang string, text string")
    assert K.collocations(K.phrases(df), 5).collect() == []
    df = sp.createDataFrame([("en", None), ("en", " . "), (None, "rare words only")], "lang string, text string")
    assert K.collocations(K.phrases(df), 5).collect() == []


@pytest.mark.parametrize("sparse", [1, 64, 1 << 40])
def test_tiles_count_exactly(monkeypatch, sparse):
    """Dense, mixed and sparse tiles give the same sums."""
    monkeypatch.setattr(K, "SPARSE", sparse)
    rnd = np.random.default_rng(2)
    ids = np.minimum(rnd.zipf(1.3, (200_000, 2)), 5000).astype(np.int64)
    code, n = (ids[:, 0] << 32) | ids[:, 1], rnd.integers(1, 1 << 40, 200_000)
    got = K.counted(code, n)
    want = Counter()
    for c, m in zip(code.tolist(), n.tolist(), strict=True):
        want[c] += m
    assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want and len(got[0]) == len(want)
    empty = np.zeros(0, dtype=np.int64)
    assert len(K.counted(empty, empty)[0]) == 0


def test_bundles_keep_tiles_whole():
    rnd = np.random.default_rng(1)
    ids = rnd.integers(1, 1 << 20, (50_000, 2))
    code = (ids[:, 0] << 32) | ids[:, 1]
    tiles, at = {}, K.bundle_of(code, 7)
    for (r, c), b in zip(zip(*K.tile_of(code), strict=True), at, strict=True):
        assert tiles.setdefault((int(r), int(c)), b) == b
    assert set(at) <= {-4, -3, -2, -1, *range(7)} and K.bundle_of(np.array([(5 << 32) | 1500]), 7)[0] == -2


def test_packing_and_pieces():
    for x in (np.array([], dtype=np.int64), np.array([0, 1, -1, 2 ** 62], dtype=np.int64)):
        assert (K.unpacked(K.packed(x), "<i8") == x).all()
    text = "Ab c. d;e f\tg,.h " * 50
    for most in (1, 7, 100, 10_000):
        cut = list(K.pieces(text.encode(), most))
        assert b"".join(cut) == text.encode()
        assert sum([[w for w in K.words(c) if w != b"."] for c in cut], []) == [w for w in K.words(text.encode()) if w != b"."]
