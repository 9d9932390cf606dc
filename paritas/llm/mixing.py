"""Mixing sources to target weights by hierarchical budgeting.

Weights stand at the nodes of a tree of sources, by default domain, language,
source. A budget of tokens flows from the root: at each node it is shared
among the children by weight, no child gets more than its subtree can give
(its tokens times ``max_epochs``), and what a child cannot use goes to its
siblings by weight. Since a node's capacity is the sum of its children's, a
shortage leaves a family only when all siblings are exhausted. Each leaf then
takes whole passes ("epochs") over its documents and, for the rest of its
budget, a prefix of the next epoch's seeded order.

Sharing and capacities are computed on a catalogue with one row per node. The
prefix sums of a leaf's seeded order go in two steps, over hash slices of
about ``SLICE_DOCS`` documents and then within each, so that a leaf with a
third of all rows is spread over many tasks.

Defined results: a null level value is a value of its own; null and empty
texts have 0 tokens, and are taken with every whole epoch; a leaf without
tokens takes nothing; a missing weight counts as ``default_weight``, a weight
of 0 or less excludes the node unless all its siblings have it too; equal keys
in the seeded order are taken in the order of their text's hash, and rows that
are the same in key and text side by side; a budget above all capacity takes
everything ``max_epochs`` times; an empty table gives an empty result. Other
columns of the input are kept by ``mixed`` and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.llm.common import WORD, written

#: Documents per hash slice of a leaf's seeded order, about.
SLICE_DOCS = 20_000


def word_tokens(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def share(nodes: DataFrame, parent: list[str], budget: str, order: list[str]) -> DataFrame:
    """Split ``budget`` of each parent among its child rows (``weight``,
    ``capacity``): column ``target``.

    Children are ordered by capacity per weight; those before the first one
    that can take its share in full are exhausted. With running sums of
    capacity and remaining weight this needs no iteration."""
    near = Window.partitionBy(*parent).orderBy("_ratio", *order)
    before = near.rowsBetween(Window.unboundedPreceding, -1)
    after = near.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    x = nodes.withColumn("_all", F.sum(F.greatest(F.col("weight"), F.lit(0.0))).over(whole)) \
        .withColumn("_w", F.when(F.col("_all") > 0, F.greatest(F.col("weight"), F.lit(0.0))).otherwise(F.lit(1.0))) \
        .withColumn("_ratio", F.when(F.col("_w") > 0, F.col("capacity") / F.col("_w")).otherwise(F.lit(1e300)))
    x = x.withColumn("_used", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast("double")) \
        .withColumn("_left", F.sum("_w").over(after)) \
        .withColumn("_rate", F.when(F.col("_left") > 0, (F.col(budget) - F.col("_used")) / F.col("_left")).otherwise(F.lit(0.0))) \
        .withColumn("_full", F.col("_ratio") <= F.col("_rate"))
    # The rate of the first child that is not exhausted, the largest, holds for all after it.
    rate = F.max(F.when(~F.col("_full"), F.col("_rate"))).over(whole)
    x = x.withColumn("_open", rate)
    target = F.when(F.col("_full") | F.col("_open").isNull(), F.col("capacity").cast("double")) \
        .otherwise(F.least(F.col("_w") * F.greatest(F.col("_open"), F.lit(0.0)), F.col("capacity").cast("double")))
    return x.withColumn("target", F.round(target, 6)).drop("_all", "_w", "_ratio", "_used", "_left", "_rate", "_full", "_open")


def budgets(leaves: DataFrame, weights: DataFrame, levels: list[str], total: float | Column,
            max_epochs: int, default_weight: float = 1.0) -> DataFrame:
    """Per leaf (``levels``, ``tokens``, ``docs``): its ``budget`` in tokens.

    ``weights`` has ``path`` (the level values of a node joined by ``/``) and
    ``weight``. One row per node at every step."""
    path = lambda n: F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in levels[:n]])
    w = weights.groupBy(F.col("path").alias("_path")).agg(F.max(F.col("weight").cast("double")).alias("_weight"))
    # Capacities from the leaves up: what an excluded node holds is no capacity of its parent.
    tree, below = {}, leaves.select(*levels, "tokens", "docs", (F.col("tokens") * max_epochs).alias("capacity"))
    for n in range(len(levels), 0, -1):
        nodes = below.groupBy(*levels[:n]).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
        nodes = nodes.withColumn("_path", path(n)).join(w, "_path", "left") \
            .withColumn("weight", F.greatest(F.coalesce("_weight", F.lit(float(default_weight))), F.lit(0.0))).drop("_path", "_weight")
        family = Window.partitionBy(*levels[:n - 1]) if n > 1 else Window.partitionBy(F.lit(0))
        excluded = (F.col("weight") == 0) & (F.max("weight").over(family) > 0)
        below = tree[n] = nodes.withColumn("capacity", F.when(excluded, F.lit(0)).otherwise(F.col("capacity")).cast("bigint"))
    now = share(tree[1].withColumn("_budget", total if isinstance(total, Column) else F.lit(float(total))).withColumn("_root", F.lit(0)),
                ["_root"], "_budget", levels[:1]).drop("_root", "_budget")
    for n in range(2, len(levels) + 1):
        up = now.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(levels[:n - 1])], F.col("target").alias("_budget"))
        same = [tree[n][c].eqNullSafe(up[f"_p{i}"]) for i, c in enumerate(levels[:n - 1])]
        nodes = tree[n].join(up, same).drop(*[f"_p{i}" for i in range(n - 1)])
        now = share(nodes, levels[:n - 1], "_budget", levels[:n]).drop("_budget")
    return now.select(*levels, "tokens", "docs", "weight", F.floor("target").cast("bigint").alias("budget"))


def fraction_of(leaves: DataFrame, part: float) -> float:
    """``part`` of all tokens of the catalogue, as a number of tokens."""
    got = leaves.agg(F.sum("tokens")).first()[0]
    return float(int((got or 0) * part))


def selected(rows: DataFrame, plan: DataFrame, levels: list[str], seed: int) -> DataFrame:
    """Epochs of each row of ``rows`` (``row_key``, ``row_hash``, levels,
    ``tokens``): ``row_key``, ``row_hash``, ``whole`` (number of whole epochs),
    ``part_tokens`` (tokens counted in the partial epoch; null: not in it) and
    ``mix_order`` (the seeded place in it)."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_full").cast("string"),
                              F.coalesce(F.col("row_key").cast("string"), F.lit("null"))))
    p = plan.withColumn("_full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("int")) \
        .withColumn("_rest", (F.col("budget") - F.col("_full") * F.col("tokens")).cast("bigint")) \
        .withColumn("_digits", F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("docs") / SLICE_DOCS))).cast("int"))
    p = p.select(*[F.col(c).alias(f"_q{i}") for i, c in enumerate(levels)], "_full", "_rest", "_digits")
    same = [rows[c].eqNullSafe(p[f"_q{i}"]) for i, c in enumerate(levels)]
    x = rows.join(p, same).drop(*[f"_q{i}" for i in range(len(levels))])
    x = x.withColumn("mix_order", order).withColumn("_slice", F.expr("substring(mix_order, 1, _digits)"))
    slices = x.groupBy(*levels, "_slice").agg(F.sum("tokens").alias("_n"))
    ahead = Window.partitionBy(*levels).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*[F.col(c).alias(f"_q{i}") for i, c in enumerate(levels)], F.col("_slice").alias("_s"),
                           F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    same = [x[c].eqNullSafe(slices[f"_q{i}"]) for i, c in enumerate(levels)] + [x["_slice"] == slices["_s"]]
    x = x.join(slices, same).drop("_s", *[f"_q{i}" for i in range(len(levels))])
    inside = Window.partitionBy(*levels, "_slice").orderBy("mix_order", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_ahead") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    x = x.withColumn("_start", start)
    part = F.when(F.col("_start") < F.col("_rest"), F.least(F.col("tokens"), F.col("_rest") - F.col("_start")))
    return x.select("row_key", "row_hash", *levels, "tokens", F.col("_full").alias("whole"), part.alias("part_tokens"),
                    "mix_order").where("whole > 0 OR part_tokens IS NOT NULL")


def catalogue(rows: DataFrame, levels: list[str]) -> DataFrame:
    """One row per leaf: tokens and documents."""
    return rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def counted(df: DataFrame, levels: dict[str, Column], key: str = "doc_id", text: str = "text",
            tokens: Column | None = None) -> DataFrame:
    """The narrow table that mixing works on, written once: ``row_key``,
    ``row_hash`` (of the text), the levels and ``tokens``."""
    own = word_tokens(F.col(text)) if tokens is None else F.coalesce(tokens.cast("bigint"), F.lit(0))
    rows = df.select(F.col(key).alias("row_key"), F.xxhash64(F.col(text)).alias("row_hash"),
                     *[c.cast("string").alias(name) for name, c in levels.items()], own.alias("tokens"))
    return written(rows, "mixing")


def mix(df: DataFrame, levels: dict[str, Column], weights: DataFrame, share_of_all: float, max_epochs: int,
        seed: int, key: str = "doc_id", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """One row per taken document and epoch: ``row_key``, ``row_hash``, the
    levels, ``epoch`` (from 0), ``tokens`` and ``taken_tokens``; the document
    in which a budget ends counts with the tokens up to there.

    The total budget is ``share_of_all`` of the table's tokens."""
    rows, names = counted(df, levels, key, text, tokens), list(levels)
    leaves = catalogue(rows, names)
    plan = budgets(leaves, weights, names, fraction_of(leaves, share_of_all), max_epochs)
    got = selected(rows, plan, names, seed)
    last = F.when(F.col("part_tokens").isNotNull(), F.col("whole")).otherwise(F.col("whole") - 1)
    x = got.withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    taken = F.when(F.col("epoch") < F.col("whole"), F.col("tokens")).otherwise(F.col("part_tokens"))
    return x.select("row_key", "row_hash", *names, "epoch", "tokens", taken.alias("taken_tokens"))


def mixed(df: DataFrame, taken: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` once per epoch in which ``mix`` takes them, whole.
    Rows with the same key and text are taken alike."""
    times = taken.select("row_key", "row_hash", "epoch").distinct()
    # The row travels as one column, so its own names clash with none of these.
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), df[key].alias("key"), F.xxhash64(df[text]).alias("hash"))
    return rows.join(times, F.col("key").eqNullSafe(F.col("row_key")) & (F.col("hash") == F.col("row_hash"))).select("row.*")
