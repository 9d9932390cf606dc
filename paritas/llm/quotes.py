"""Quotation linking: threads from what messages quote. DataFrame functions only.

A line's quote level is the number of ``>`` before it (blanks between them are
allowed). Neighbouring lines of one level form a passage, cut at empty lines.
A passage is compared by a hash of its normal form: lower case, blanks
collapsed, ends trimmed. Quoted passages are linked to the message that said
them itself (at level 0): the first one in the same conversation before the
quoting message, else the first one anywhere, if that stands before it in the
order of (conversation, position). A message replies to the original of its
first linked passage of the lowest quote level. Chains of replies are resolved
by pointer doubling, and a message's place in its thread is (depth, position):
parents before replies.

The parsing of a message happens inside its row (array functions). Originals
are reduced to one row per passage hash before any join, so a passage that
many messages hold or quote never meets all of them with all of them; joins
split hot keys by Spark's adaptive execution.

Defined results: null and empty texts have no passage and no parent; null
positions or conversations make a key like any other (null-safe); rows with
the same key are one message: they share links, each keeps its own text, and
the parent is the smallest linked one; a message never replies to itself or to
a later one, so there is no cycle; passages that nobody said stay unlinked;
other columns are neither read nor returned; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import written

#: Quote marks at the start of a line.
MARKS = r"^(?:[\x20\t]*>)+[\x20\t]?"
BLANK = r"[\x20\x09-\x0D ]+"


def normal(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, BLANK, " ")))


def passage_hash(text: Column) -> Column:
    """128 bits of the normal form, as text."""
    return F.substring(F.sha2(normal(text), 256), 1, 32)


def with_passages(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the array ``out`` of (level, text) of the text's passages, in
    order. One projection per step, so that each array is computed once and
    the next one looks its elements up."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    line = lambda x, i: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(x, MARKS, "").alias("body"), i.alias("i"))
    x = df.select(*kept, F.transform(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1), line).alias("_lines"))
    x = x.select(*kept, F.filter("_lines", lambda v: v["body"].rlike(r"[^\x20\x09-\x0D\u00A0]")).alias("_full"))
    # Empty lines are gone: a passage starts where the line number jumps or the level changes.
    before = lambda i: F.element_at("_full", F.greatest(i, F.lit(1)))
    new = lambda v, i: (i == 0) | (before(i)["i"] != v["i"] - 1) | (before(i)["level"] != v["level"])
    x = x.select(*kept, "_full", F.transform("_full", lambda v, i: F.when(new(v, i), i)).alias("_at"))
    x = x.select(*kept, "_full", F.filter("_at", lambda i: i.isNotNull()).alias("_at"))
    end = lambda k: F.coalesce(F.get("_at", k + 1), F.size("_full"))
    passage = lambda at, k: F.struct(
        F.get("_full", at)["level"].alias("level"),
        F.array_join(F.transform(F.slice("_full", at + 1, end(k) - at), lambda v: v["body"]), "\n").alias("text"))
    return x.select(*kept, F.transform("_at", passage).alias(out))


def parsed(messages: DataFrame, conv: str, pos: str, text: str) -> DataFrame:
    """One row per passage of a message row (one with nulls where it has none):
    ``msg`` (struct of conversation and position), ``n``, ``level``, ``text`` and
    ``hash``; written once, as it is read several times."""
    key = F.struct(F.col(conv).alias("conv"), F.col(pos).alias("pos"))
    x = with_passages(messages.select(key.alias("msg"), F.col(text).alias("_text")), "_text", "_passages")
    x = x.select("msg", F.posexplode_outer("_passages").alias("n", "p"))
    return written(x.select("msg", "n", "p.level", "p.text", passage_hash(F.col("p.text")).alias("hash")), "quotes")


def own_texts(messages: DataFrame, conv: str, pos: str, text: str) -> DataFrame:
    """One row per message row: ``msg`` and ``own_text``, the text without
    quoted lines and blanks at its ends (null stays null)."""
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda x: ~x.rlike(r"^[\x20\t]*>"))
    return messages.select(F.struct(F.col(conv).alias("conv"), F.col(pos).alias("pos")).alias("msg"),
                           F.regexp_replace(F.array_join(kept, "\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("own_text"))


def links(found: DataFrame) -> DataFrame:
    """One row per quoted passage of a message: ``msg``, ``n``, ``level``,
    ``hash``, ``original`` (null where nobody said it before)."""
    said = found.where("level = 0 AND text IS NOT NULL")
    near = said.groupBy("hash", F.col("msg.conv").alias("conv")).agg(F.min("msg").alias("near"))
    # The first of all: from the pre-aggregated rows, not from all messages.
    far = near.groupBy("hash").agg(F.min("near").alias("far"))
    quoted = found.where("level > 0").select("msg", "n", "level", "hash")
    near = near.select(F.col("hash").alias("h1"), F.col("conv").alias("c1"), "near")
    far = far.select(F.col("hash").alias("h2"), "far")
    x = quoted.join(near, (F.col("hash") == F.col("h1")) & F.col("msg.conv").eqNullSafe(F.col("c1")), "left") \
        .join(far, F.col("hash") == F.col("h2"), "left")
    earlier = lambda c: F.when(F.col(c) < F.col("msg"), F.col(c))
    return x.select("msg", "n", "level", "hash", F.coalesce(earlier("near"), earlier("far")).alias("original"))


def parents(linked: DataFrame) -> DataFrame:
    """``msg`` and ``parent``: the original of the first linked passage of the
    lowest level."""
    best = linked.where("original IS NOT NULL").groupBy("msg") \
        .agg(F.min(F.struct("level", "n", "original")).alias("b"))
    return best.select("msg", F.col("b.original").alias("parent"))


def threads(keys: DataFrame, linked: DataFrame) -> DataFrame:
    """``msg``, ``parent``, ``root`` and ``depth`` of every distinct message.
    Each round of pointer doubling is written out; their number is the
    logarithm of the longest chain."""
    now = keys.select("msg").distinct().join(parents(linked), "msg", "left") \
        .select("msg", "parent", F.coalesce("parent", "msg").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    now = written(now, "threads")
    done: list[DataFrame] = []
    active = everyone = now
    while True:
        # Only messages whose pointer moved go on; they meet only pointers that lead somewhere.
        onward = everyone.where("depth > 0").select(F.col("msg").alias("m2"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        moved = active.join(onward, active["up"] == onward["m2"], "left")
        step = written(moved.select("msg", "parent", F.coalesce("up2", "up").alias("up"),
                                    (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
                                    F.col("m2").isNotNull().alias("moved")), "threads")
        done.append(step.where("NOT moved").drop("moved"))
        active = step.where("moved").drop("moved")
        everyone = reduce(DataFrame.unionAll, [*done, active])
        if active.isEmpty():
            return reduce(DataFrame.unionAll, done).select(
                "msg", "parent", F.col("up").alias("root"), F.col("depth").cast("bigint").alias("depth"))


def conversations(messages: DataFrame, conv: str = "conv_id", pos: str = "turn", text: str = "text") -> DataFrame:
    """One row per message row: its key, ``root_conv``/``root_pos`` (its
    thread), ``depth``, ``parent_conv``/``parent_pos``, ``n_quoted``,
    ``n_linked`` and ``own_text``. Sorting by (root, depth, key) gives the
    thread in reply order; ``write_threads`` does so at scale."""
    found = parsed(messages, conv, pos, text)
    linked = links(found)
    counts = linked.groupBy("msg").agg(F.count(F.lit(1)).alias("n_quoted"), F.count("original").alias("n_linked"))
    t = threads(found, linked).join(counts, "msg", "left")
    x = own_texts(messages, conv, pos, text)
    same = x["msg"].eqNullSafe(t["msg"])
    return x.join(t, same, "left").select(
        x["msg"]["conv"].alias(conv), x["msg"]["pos"].alias(pos),
        F.col("root.conv").alias("root_conv"), F.col("root.pos").alias("root_pos"), "depth",
        F.col("parent.conv").alias("parent_conv"), F.col("parent.pos").alias("parent_pos"),
        F.coalesce("n_quoted", F.lit(0)).cast("bigint").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "own_text")


def write_threads(threaded: DataFrame, path: str, conv: str = "conv_id", pos: str = "turn") -> None:
    """Write the messages in reply order; a large thread spans several files."""
    order = ["root_conv", "root_pos", "depth", conv, pos]
    threaded.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def quoting_mail(turns: DataFrame, conv: str = "conv_id", pos: str = "turn", text: str = "text") -> DataFrame:
    """Mail-like messages of a table of turns without quotes: each message
    carries the turn before it at level 1 and the one before that at level 2,
    then its own text. For tables that hold plain turns."""
    said = turns.groupBy(F.col(conv).alias("_c"), F.col(pos).alias("_t")).agg(F.min(text).alias("_said"))
    x = turns.select(conv, pos, text)
    for back in (1, 2):
        past = said.select(F.col("_c").alias(f"_c{back}"), (F.col("_t") + back).alias(f"_t{back}"), F.col("_said").alias(f"_said{back}"))
        x = x.join(past, (F.col(conv) == F.col(f"_c{back}")) & (F.col(pos) == F.col(f"_t{back}")), "left")
    quote = lambda c, mark: F.concat(F.lit(mark), F.regexp_replace(c, "\n", "\n" + mark), F.lit("\n"))
    body = F.concat(F.coalesce(quote(F.col("_said2"), ">> "), F.lit("")), F.coalesce(quote(F.col("_said1"), "> "), F.lit("")),
                    F.col(text))
    return x.select(conv, pos, body.alias(text))
