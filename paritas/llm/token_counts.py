"""Token counts: what a public tokenizer would give, lengths only.

Texts are cut into segments of a bounded size at safe boundaries and packed
into batches of about equal bytes; the library encodes the distinct parts of a
batch in one call, and only their lengths are kept. A batch holds at most
``BATCH_CHARS`` characters whatever the length of a document, so memory does
not follow the longest text. Parts met before keep their length in a table of
bounded size per worker process.

A boundary is safe where no token can cross it and neither side's tokens
depend on the other:

* byte-level tokenizers (``.json``): before a space or line break that follows
  a non-blank character. A blank starts a new word there, no word reaches over
  it, and the pattern looks ahead only behind blanks. Added tokens without
  blanks never reach over one either. In texts without added tokens also
  between a letter and ASCII punctuation, since a word has letters only.
* sentence pieces (``.model``): at a single space between non-blank
  characters, where no piece of the vocabulary crosses a space mark and a text
  gets a mark in front: the part behind the space has the space back as that
  mark. Texts with the mark's own character stay whole.

A tokenizer of another build (normalizer, prefix space, added tokens with
blanks) gets whole texts, in the same batches.

Defined results: null and empty texts have no bytes and no tokens; repeated
rows are counted each by itself; a null key is a key like any other; other
columns are neither read nor returned; an empty table gives an empty result.
Special strings inside a text are handled as the library does by default.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A batch closes at this many characters; a longer text is cut into segments.
BATCH_CHARS = 1 << 20
SEGMENT_CHARS = 1 << 18
#: Lengths kept per worker: so many parts in each of two generations, none longer than this.
KEPT_PARTS, KEPT_CHARS = 400_000, 64
#: Distinct parts that the library gets in one call, by characters.
CALL_CHARS = 1 << 18

#: Parts of a text for byte-level tokenizers; together they are the text.
BLANK_PARTS = r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+"
WORD_PARTS = re.compile(r"[ \n]?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+(?=[!-/:-@\[-`{-~ \n]|\Z)|" + BLANK_PARTS)
BLANK_PARTS = re.compile(BLANK_PARTS)
BYTE_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Parts for sentence pieces: all that lies between the cuts.
PIECE_CUT = re.compile(r"(?<=\S) (?=\S)")
MARK = "▁"


class Counter:
    """Token counts by one of the two libraries."""

    def __init__(self, tokenizer_file: str):
        self.kept: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.cut, self.parts, self.gap = None, None, 0
        if tokenizer_file.endswith(".model"):
            self._pieces(tokenizer_file)
        else:
            self._words(tokenizer_file)

    def _words(self, path: str) -> None:
        from tokenizers import Tokenizer

        # A task has its core; the library's own threads would take others'.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.lengths = lambda texts: [len(e) for e in encode(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") \
            and not spec.get("normalizer")
        if plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                             for t in spec.get("added_tokens", [])):
            added = [t["content"] for t in spec.get("added_tokens", [])]
            self.cut = BYTE_CUT
            self.parts = lambda text: (BLANK_PARTS if any(a in text for a in added) else WORD_PARTS).findall(text)

    def _pieces(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.lengths = lambda texts: [len(e) for e in sp.encode(texts, num_threads=1)]
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        # Only a model whose normalizer keeps a text as it is and puts one mark in front.
        shown = "Ａ ﬁ  x\n² y "
        if not crossing and sp.normalize(shown) == MARK + shown.replace(" ", MARK):
            self.cut, self.parts, self.gap = PIECE_CUT, PIECE_CUT.split, 1

    def segments(self, text: str) -> Iterator[str]:
        """The text in segments of some ``SEGMENT_CHARS`` between safe boundaries."""
        if self.cut is None or self.gap and MARK in text:
            yield text
            return
        at = 0
        while len(text) - at > SEGMENT_CHARS and (m := self.cut.search(text, at + SEGMENT_CHARS)):
            yield text[at:m.start()]
            at = m.start() + self.gap
        yield text[at:]

    def counts(self, segments: list[str]) -> np.ndarray:
        """Tokens of each segment, by one look at each distinct part."""
        split = [[s] if self.parts is None or self.gap and MARK in s else self.parts(s) for s in segments]
        kept, old = self.kept, self.old
        new = {p for parts in split for p in parts if p not in kept}
        now = {p: old[p] for p in new if p in old}
        first = list(new - now.keys())
        now.update(zip(first, (n for call in balanced(first, CALL_CHARS) for n in self.lengths(call)), strict=True))
        if len(kept) + len(now) > KEPT_PARTS:
            self.old, self.kept = kept, {}
        self.kept.update((p, n) for p, n in now.items() if len(p) <= KEPT_CHARS)
        out = np.array([sum([kept[p] if p in kept else now[p] for p in parts]) for parts in split], dtype=np.int64)
        return out


def balanced(texts: list[str], most: int) -> Iterator[list[str]]:
    """The texts in order, in groups of about ``most`` characters."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


_COUNTERS: dict[str, Counter] = {}


def worker_counter(tokenizer_file: str) -> Counter:
    """One counter per worker process, kept between its tasks."""
    if tokenizer_file not in _COUNTERS:
        _COUNTERS[tokenizer_file] = Counter(tokenizer_file)
    return _COUNTERS[tokenizer_file]


def text_counts(counter: Counter, texts: list[str | None]) -> np.ndarray:
    """Tokens of each text, batches of segments one after another."""
    out = np.zeros(len(texts), dtype=np.int64)
    group, owner, held = [], [], 0

    def flush() -> None:
        nonlocal group, owner, held
        if group:
            np.add.at(out, owner, counter.counts(group))
        group, owner, held = [], [], 0

    for i, text in enumerate(texts):
        for s in counter.segments(text) if text else ():
            group.append(s)
            owner.append(i)
            held += len(s)
            if held >= BATCH_CHARS:
                flush()
    flush()
    return out


def counted(df: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row of ``df``."""
    rows = df.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("row_text"),
                     F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"))
    kind = rows.schema["row_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = text_counts(worker_counter(tokenizer_file), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n)], ["row_key", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"row_key {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("row_key", key)


def totals(counts: DataFrame, *by: str) -> DataFrame:
    """Documents, bytes and tokens by the given columns of ``counts``."""
    return counts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_bytes").alias("n_bytes"),
                                   F.sum("n_tokens").alias("n_tokens"))
