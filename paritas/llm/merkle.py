"""Merkle manifest of a table: a digest per row, per group and for the whole,
with the proof of every row.

A row's leaf is a digest over fields of known length. Within a group leaves
are ordered by key; every eight consecutive nodes (the last run may be
shorter) become their parent until one is left, the group's subroot. The
subroots, ordered by group, become the root in the same way.

Nodes are kept in aligned blocks of ``FAN ** LEVELS``. A block holds each of
its levels as one string of digests side by side: parents are digests of its
fixed-width substrings, and the siblings of a node are the substrings on its
left and right in its run. The tops of the blocks are the nodes of the next
tier, cut into blocks again, until a group has one block. Proofs come down the
tiers: a block gets the siblings above it by one join and puts them behind
those of its own nodes. So no task holds more than a block, a group may hold
any share of the rows, and tiers grow with the logarithm of the largest group.

Leaves are written once; order numbers come from them, range-partitioned and
sorted by (group, key, leaf), and written to the shared folder with their place; counts per part and group,
added up, make the numbers exact whatever the parts are.

Defined results: a null field is ``-``, unlike any text; a null key comes
first, a null group is a group of its own and comes first; rows with equal keys
are ordered by leaf, so repeated rows are separate leaves with proofs of their
own; a group of one row has its leaf as subroot, one group its subroot as root;
an empty table has no proofs and no root; other columns are not read unless
asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.llm import common as C

FAN, HEX = 8, 64
#: Levels of a block: 512 nodes, 32 KB of digests on its lowest level.
LEVELS = 3
BLOCK = FAN ** LEVELS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value (numbers in decimals)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, nothing else changed."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


# ---------------------------------------------------------------- order


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, the place within its group from 0 in ``order``,
    and ``n``, the size of the group. ``group`` has no nulls. Rows are written
    once; each part's runs of a group start after those of the parts before."""
    put = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order) \
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    put = C.written(put, name)
    runs = put.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    runs = runs.select(group, "_part", "_first", F.sum("_n").over(whole).alias("n"),
                       (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")).alias("_before"))
    return put.join(runs, [group, "_part"]) \
        .withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


# ---------------------------------------------------------------- tiers


def parents(level: Column, done: Column) -> Column:
    """The level above a string of digests; itself where ``done``."""
    runs = F.ceil(F.length(level) / (FAN * HEX)).cast("int")
    up = F.transform(F.sequence(F.lit(0), runs - 1),
                     lambda i: F.sha2(F.substring(level, i * (FAN * HEX) + 1, F.lit(FAN * HEX)).cast("binary"), 256))
    return F.when(done, level).otherwise(F.array_join(up, ""))


def blocks(nodes: DataFrame, name: str) -> DataFrame:
    """Blocks of nodes (``g``, ``pos``, ``n``, ``hash`` and others): ``rows`` in
    order and the level strings ``l0`` ... . Where a block is all of its group,
    levels end at the single node; else every level is computed."""
    body = nodes.groupBy("g", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.max("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("pos", *[c for c in nodes.columns if c not in ("g", "pos", "n")]))).alias("rows"))
    body = body.withColumn("l0", F.array_join(F.col("rows.hash"), ""))
    for j in range(LEVELS):
        done = (F.col("n") <= BLOCK) & (F.length(f"l{j}") <= HEX)
        body = body.withColumn(f"l{j + 1}", parents(F.col(f"l{j}"), done))
    return C.written(body, name)


def tops(tier: DataFrame) -> DataFrame:
    """The nodes of the next tier: one per block."""
    return tier.select("g", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"),
                       F.col(f"l{LEVELS}").alias("hash"))


def siblings(i: Column) -> Column:
    """Left and right siblings of a block's node ``i`` on each level that it has."""
    steps = []
    for j in range(LEVELS):
        level = F.col(f"l{j}")
        at = F.shiftright(i, 3 * j)
        left = F.substring(level, at.bitwiseAND(F.lit(~(FAN - 1))) * HEX + 1, at.bitwiseAND(F.lit(FAN - 1)) * HEX)
        right = F.substring(level, at * HEX + (HEX + 1), (F.lit(FAN - 1) - at.bitwiseAND(F.lit(FAN - 1))) * HEX)
        there = (F.col("n") > BLOCK) | (F.length(level) > HEX)
        steps.append(F.when(there, F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def opened(tops: DataFrame, extra: list[str]) -> DataFrame:
    """Every node of blocks that come with the siblings above them (``up``) and
    the columns ``extra``: its columns and all its siblings (``path``), those
    in its block first."""
    nodes = F.transform("rows", lambda r, i: F.struct(r.alias("r"), F.concat(siblings(i), F.col("up")).alias("path")))
    return tops.select("g", *extra, F.explode(nodes).alias("x")).select("g", *extra, "x.r.*", "x.path")


def descended(tiers: list[DataFrame], above: DataFrame, extra: list[str]) -> DataFrame:
    """The lowest nodes of the tiers, given what lies above each block of the
    last one (``g``, ``block``, ``up`` and the columns ``extra``)."""
    for tier in reversed(tiers):
        nodes = opened(tier.join(above, ["g", "block"]), extra)
        above = nodes.select("g", F.col("pos").alias("block"), F.col("path").alias("up"), *extra)
    return nodes


def raised(nodes: DataFrame, name: str) -> list[DataFrame]:
    """All tiers over the nodes; the last has one block per group."""
    tiers = [blocks(nodes, f"{name}-0")]
    most = tiers[0].agg(F.max("n")).first()[0] or 0
    while most > BLOCK:
        tiers.append(blocks(tops(tiers[-1]), f"{name}-{len(tiers)}"))
        most = -(-most // BLOCK)
    return tiers


# ---------------------------------------------------------------- manifest


@dataclass(frozen=True)
class Manifest:
    """Tiers over the leaves of each group, and over the subroots."""
    tiers: list[DataFrame]
    group_tiers: list[DataFrame]

    def root(self) -> DataFrame:
        """``root``: one row, none for an empty table."""
        return self.group_tiers[-1].select(F.col(f"l{LEVELS}").alias("root"))

    def groups(self) -> DataFrame:
        """Each group with its subroot, the subroot's siblings up to the root, and the root."""
        *lower, last = self.group_tiers
        # The last tier is one block: nothing lies above it.
        top = last.withColumn("up", F.expr("cast(array() as array<struct<left:string,right:string>>)")) \
            .withColumn("root", F.col(f"l{LEVELS}"))
        nodes = opened(top, ["root"])
        if lower:
            above = nodes.select("g", F.col("pos").alias("block"), F.col("path").alias("up"), "root")
            nodes = descended(lower, above, ["root"])
        return nodes.select(F.col("name").alias("g"), "group", F.col("hash").alias("subroot"), "path", "root")

    def proofs(self) -> DataFrame:
        """Every row's ``key``, ``group``, ``leaf``, kept columns, ``subroot``,
        ``root`` and ``path``: siblings on the left and right, level by level."""
        top = self.groups().withColumnRenamed("path", "up").withColumn("block", F.lit(0).cast("bigint"))
        x = descended(self.tiers, top, ["group", "subroot", "root"])
        return x.drop("g", "pos").withColumnRenamed("hash", "leaf")


def manifest(df: DataFrame, fields: list[str], key: str = "doc_id", group: str = "lang",
             keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``df`` over the given fields. ``keep`` are columns,
    computed from the row, that its proof shall carry."""
    kept = {f"keep_{k}": v for k, v in (keep or {}).items()}
    rows = df.select(F.col(key).alias("key"), field(F.col(group)).alias("g"),
                     leaf(*[F.col(c) for c in fields]).alias("hash"), *[v.alias(k) for k, v in kept.items()])
    rows = C.written(rows, "leaves")  # texts are read once; sampling the order reads digests
    tiers = raised(numbered(rows, "g", ["key", "hash", *kept], "placed"), "tier")
    value = F.expr("CASE WHEN g <> '-' THEN substring(g, instr(g, ':') + 1) END").cast(df.schema[group].dataType)
    roots = tiers[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), value.alias("group"), F.col(f"l{LEVELS}").alias("hash"))
    return Manifest(tiers, raised(numbered(roots, "g", ["group"], "subroots"), "group-tier"))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, from left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf leads to by its path."""
    return F.aggregate(path, start, lambda acc, s: digest(s["left"], acc, s["right"]))
