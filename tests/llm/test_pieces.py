"""Sampled pieces: lossless, reproducible, and from the right distribution."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paritas.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return pieces.load(MODEL)


def split(ids, ends):
    return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n▁.,ab")), max_size=30), min_size=1, max_size=5))
def test_lossless(texts):
    v = _vocab()
    got = split(*pieces.encode_group(v, list(range(len(texts))), texts, 3))
    assert [pieces.decode(v, x) for x in got] == texts


_cache = []


def _vocab():
    if not _cache:
        _cache.append(pieces.load(MODEL))
    return _cache[0]


def test_agrees_with_the_library_on_decoding(vocab):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ("A house, a  cat\nand 3.14 dogs!", "日本語 🙂 é"):
        ids = pieces.encode_group(vocab, [1], [text], 2)[0].tolist()
        assert sp.decode(ids) == text and pieces.decode(vocab, sp.encode(text)) == text


@pytest.mark.parametrize("word,text", [("▁hear", "hear"), ("▁anz.", "anz."), ("▁▁in", " in")])
def test_distribution(vocab, word, text):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not sp.is_byte(i) and not sp.is_control(i) and not sp.is_unknown(i)}

    def ways(s):
        return [()] if not s else [(ids[s[:k]], *r) for k in range(1, len(s) + 1) if s[:k] in ids for r in ways(s[k:])]
    weight = {w: np.exp(sum(vocab.weight[i] for i in w)) for w in ways(word)}
    n = 20_000
    got = Counter(map(tuple, split(*pieces.encode_group(vocab, list(range(n)), [text] * n, 5))))
    total = sum(weight.values())
    assert set(got) <= set(weight) and max(abs(got[w] / n - weight[w] / total) for w in weight) < 0.015


def test_seeded_by_key_alone(vocab):
    texts = ["the house on the hill " * 4, "another text", "the house on the hill " * 4]
    a = split(*pieces.encode_group(vocab, [7, 8, 9], texts, 1))
    b = split(*pieces.encode_group(vocab, [9, 7], [texts[2], texts[0]], 1))
    assert a[0] == b[1] and a[2] == b[0] and a[0] != a[2]
    assert split(*pieces.encode_group(vocab, [7], texts[:1], 2))[0] != a[0]


def test_spark(sp):
    rows = [(1, None), (2, ""), (3, "Some words."), (3, "Some words."), (None, "x▁y"), (4, "long " * 20_000)]
    df = sp.createDataFrame([(*r, [1]) for r in rows], "doc_id bigint, text string, ids array<int>")
    got = pieces.encoded(df, MODEL)
    x = got.collect()
    assert all(r.lossless for r in x) and len({tuple(r.ids) for r in x if r.doc_id == 3}) == 1
    assert sorted(r.n_ids for r in x)[:2] == [0, 0]
    again = {(r.doc_id, r.ids_crc32) for r in pieces.encoded(df.repartition(5), MODEL).collect()}
    assert again == {(r.doc_id, r.ids_crc32) for r in x}
    texts = sorted((r.doc_id or 0, r.text) for r in pieces.decoded(got, MODEL).collect())
    assert texts == sorted((k or 0, t or "") for k, t in rows)
    assert pieces.encoded(df.limit(0), MODEL).count() == 0
