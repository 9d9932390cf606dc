"""The manifest against a plain one in Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from paritas.llm import merkle as M


def h(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """The top of a list of digests, and each one's siblings per level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(paths):
            run = at[i] // 8 * 8
            p.append(("".join(level[run:at[i]]), "".join(level[at[i] + 1:run + 8])))
        level = [h(*level[i:i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def plain(rows):
    """(key, leaf, subroot, root, path) of (key, group, text) rows."""
    groups = {}
    for k, g, t in rows:
        groups.setdefault(g, []).append((k is not None, k or 0, h(field(k), field(t)), k))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: climb([x[2] for x in sorted(groups[g])]) for g in order}
    root, above = climb([tops[g][0] for g in order])
    return sorted((str(x[3]), x[2], tops[g][0], root, tuple(tops[g][1][i] + above[j]))
                  for j, g in enumerate(order) for i, x in enumerate(sorted(groups[g])))


def got(m):
    return sorted((str(r.key), r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in m.proofs().collect())


@pytest.mark.parametrize("levels", [1, 3])
def test_same_as_plain(sp, monkeypatch, levels):
    """Blocks of eight nodes make several tiers of leaves and of groups."""
    monkeypatch.setattr(M, "LEVELS", levels)
    monkeypatch.setattr(M, "BLOCK", 8 ** levels)
    rnd = random.Random(3)
    sizes = {"en": 73, None: 1, "": 2, "é": 8, "z": 9, "-": 64, "de": 65, **{f"g{i}": 1 for i in range(4)}}
    rows = [(rnd.randrange(1000), g, rnd.choice(["A b", "", None, "ÄÖ:1"])) for g, n in sizes.items() for _ in range(n)]
    rows += [(None, "en", "x"), (5, "en", "same"), (5, "en", "same"), (5, "en", "other")]
    df = sp.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(5)
    assert got(M.manifest(df, ["doc_id", "text"])) == plain(rows)


def test_one_row_and_none(sp):
    df = sp.createDataFrame([(1, None, "a")], "doc_id bigint, lang string, text string")
    leaf = h(field(1), field("a"))
    assert got(M.manifest(df, ["doc_id", "text"])) == [("1", leaf, leaf, leaf, ())]
    m = M.manifest(df.limit(0), ["doc_id", "text"])
    assert got(m) == [] and m.root().collect() == []


def test_tampering_and_clashing_names(sp):
    rows = [(i, "en" if i % 3 else "fr", f"Text {i}" if i % 2 else f"text {i}", "x", "y") for i in range(40)]
    df = sp.createDataFrame(rows, "doc_id bigint, lang string, text string, hash string, pos string")
    fields = ["doc_id", "lang", "text", "hash", "pos"]
    lower = M.leaf(*[M.ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in fields])
    x = M.manifest(df, fields, keep={"hash": lower, "path": F.col("pos")}).proofs()
    seen = x.select("key", "keep_path", (M.folded(F.col("keep_hash"), F.col("path")) == F.col("root")).alias("ok"),
                    (M.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("own"),
                    M.proof_digest(F.col("path")).alias("p"), "path").collect()
    assert len(seen) == 40 and all(r.own and r.keep_path == "y" for r in seen)
    assert all(r.ok == (r.key % 2 == 0) for r in seen)
    assert all(r.p == h(*[s.left + s.right for s in r.path]) for r in seen)


def test_lower_case_is_ascii_only(sp):
    texts = ["ABC xyz", "ÄÖÜ İ AZ", "", None, "ΣΑΣ Q"]
    df = sp.createDataFrame([(t,) for t in texts], "t string")
    low = str.maketrans(M.UPPER, M.LOWER)
    assert [r[0] for r in df.select(M.ascii_lower(F.col("t"))).collect()] == [t if t is None else t.translate(low) for t in texts]
