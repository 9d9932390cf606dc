"""Token counts against the libraries themselves."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paritas.llm import token_counts as T
from paritas.llm.settings import tokenizer_file

BYTES, PIECES, WORDS = (tokenizer_file(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = ["", " ", "\n", "a", "  two  blanks ", "x<|endoftext|>y z", "a <|endoftext|> b", "don't I'll\t'so", "\x1ca\x1db ?\x1c c",
       "nb sp 　wide", "naïve Straße 東京都 ÀB", "line\r\nbreak \n\n end\n", "12 345 a1b2", "▁mark ▁▁ x", "<s> </s> <unk>",
       "👍🏽 ok", "é ́x", "tab\t tail\t "]


def library(path):
    if path.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(sp.encode(t))
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(path)
    return lambda t: len(tk.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("path", [BYTES, PIECES, WORDS])
def test_counts_are_the_librarys(path):
    rnd = random.Random(5)
    words = ["the", "Zürich", "x<|endoftext|>", "12,5", "(a)", "'s", "don't", "東京", "\t", "\x1c", "é" * 40, "▁", "<s>"]
    texts = ODD + ["".join(rnd.choice(words) + rnd.choice([" ", "  ", "\n", " \n", "", " "]) for _ in range(60)) for _ in range(80)]
    count = library(path)
    assert T.text_counts(T.Counter(path), [None, *texts]).tolist() == [0, *map(count, texts)]


@pytest.mark.parametrize("path", [BYTES, PIECES])
def test_long_texts_in_segments(path, monkeypatch):
    """Segments and batches far smaller than the texts give the same counts."""
    monkeypatch.setattr(T, "SEGMENT_CHARS", 50)
    monkeypatch.setattr(T, "BATCH_CHARS", 120)
    monkeypatch.setattr(T, "KEPT_PARTS", 20)
    texts = [" ".join(ODD * 5), "word " * 700, "no-blank-anywhere" * 90, "a  b" * 300, "\n".join(ODD)]
    counter = T.Counter(path)
    assert counter.cut is not None
    count = library(path)
    assert T.text_counts(counter, texts * 2).tolist() == [count(t) for t in texts] * 2
    assert max(len(s) for s in counter.segments("word " * 700)) <= 60


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \n\t\x1c \u0085abÉ1.'<|>　", max_size=40))
def test_parts_are_the_text(text):
    assert "".join(T.BLANK_PARTS.findall(text)) == text == "".join(T.WORD_PARTS.findall(text))
    assert T.text_counts(T._COUNTERS.setdefault(BYTES, T.Counter(BYTES)), [text])[0] == library_of_bytes()(text)


_LIB = []


def library_of_bytes():
    if not _LIB:
        _LIB.append(library(BYTES))
    return _LIB[0]


def test_rows(sp):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (2, "", None), (3, "é" * 5000, "z"), (None, "q", "z")]
    df = sp.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted(map(tuple, T.counted(df, BYTES).collect()), key=str)
    count = library(BYTES)
    want = sorted([(k, len((t or "").encode()), count(t or "")) for k, t, _ in rows], key=str)
    assert got == want
    assert T.counted(df.limit(0), BYTES).collect() == []
    total = {r.n_docs: (r.n_bytes, r.n_tokens) for r in T.totals(T.counted(df, BYTES)).collect()}
    assert total == {6: (sum(x[1] for x in want), sum(x[2] for x in want))}
    assert {r.doc_id: r.n_docs for r in T.totals(T.counted(df, BYTES), "doc_id").collect()} == {1: 2, None: 2, 2: 1, 3: 1}
