"""Token files: ids as the library gives them, order, keyed access."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paritas.llm import token_store

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(FILE)
LIB.encode_special_tokens = True
ENC = token_store.Encoder(FILE)


def ids_of(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'abst.!|0é \x1c")), max_size=40))
def test_encoder_equals_library(text):
    assert np.frombuffer(ENC.encode(text), "<u2").tolist() == ids_of(text)


@pytest.mark.parametrize("text", ["it's we'll I'd 'tis ''' word''' 's", "<|endoftext|> a", "a.\nB c,\nd|e || f", "é, naïve—x “q”", "x" * 5000, " \n ", "Ω≈ç 日本"])
def test_encoder_on_examples(text):
    assert np.frombuffer(ENC.encode(text), "<u2").tolist() == ids_of(text)


def test_generations(monkeypatch):
    monkeypatch.setattr(token_store._Parts, "MOST", 5)
    e = token_store.Encoder(FILE)
    text = " ".join(random.Random(1).choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(300))
    assert np.frombuffer(e.encode(text), "<u2").tolist() == ids_of(text)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-2**63, 2**63 - 1), max_size=200))
def test_minimal_perfect_hash(keys):
    k = np.array(sorted(keys), dtype=np.int64)
    bits, sizes, slots = token_store.build_hash(k)
    assert sorted(slots.tolist()) == list(range(len(k)))
    index = token_store.pack_index(k, np.arange(len(k)) * 7, np.arange(len(k)))
    off, num = token_store.find_keys(index, k)
    assert off.tolist() == [7 * i for i in range(len(k))] and num.tolist() == list(range(len(k)))
    others = np.array([x for x in range(1000) if x not in keys], dtype=np.int64)
    assert (token_store.find_keys(index, others)[1] == -1).all()


def test_files_and_lookup(sp, tmpdir_path):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(["the", "house", "zzxq", "1.5", "\n"]) for _ in range(r.randrange(40)))) for k in r.sample(range(-500, 100_000), 300)]
    rows += [(None, "no key"), (None, None), (rows[5][0], "again"), (200_000, None), (200_001, ""), rows[0]]
    df = sp.createDataFrame([(*x, "p") for x in rows], "doc_id bigint, text string, payload string")
    path = f"{tmpdir_path}/files"
    token_store.write(df.repartition(5), path, FILE, 2, shard_ids=500)
    assert token_store.shards(sp, path).count() > 8
    got = sorted(token_store.directory(sp, path).collect(), key=lambda x: x.start)
    assert [x.start for x in got] == [sum(y.n_ids for y in got[:i]) for i in range(len(got))]
    keys = [x.key for x in got]
    assert keys[:2] == [None, None] and keys[2:] == sorted(keys[2:]) and len(keys) == len(rows)
    crc = lambda t: zlib.crc32(np.array([*ids_of(t), 2], "<u4").tobytes())
    assert sorted((x.key or 0, x.n_ids, x.ids_crc32) for x in got) == sorted((k or 0, len(ids_of(t)) + 1, crc(t)) for k, t in rows)
    want = [k for k, _ in rows if k is not None][::3] + [rows[5][0], 123_456_789, -400_000, None]
    found = {x.doc_id: list(x.ids) for x in token_store.lookup(sp, path, sp.createDataFrame([(k,) for k in want], "doc_id bigint")).collect()}
    assert set(found) == {k for k in want if k in {x for x, _ in rows} and k is not None}
    for k, ids in found.items():
        own = [[*ids_of(t), 2] for x, t in rows if x == k]
        assert sorted(ids) == sorted(sum(own, [])) and (len(own) > 1 or ids == own[0])


def test_empty_table(sp, tmpdir_path):
    df = sp.createDataFrame([], "doc_id bigint, text string")
    token_store.write(df, f"{tmpdir_path}/none", FILE, 2)
    assert token_store.directory(sp, f"{tmpdir_path}/none").count() == 0
    assert token_store.lookup(sp, f"{tmpdir_path}/none", df).count() == 0


def test_documents_with_added_tokens_equal_library(sp, tmpdir_path):
    lib = Tokenizer.from_file(FILE)  # as it comes, with its added tokens
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y\n", "a <|endoftext> b", "it's plain"]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [np.frombuffer(ENC.document(t), "<u2").tolist() for t in texts] == want
    path = f"{tmpdir_path}/added"
    token_store.write(sp.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), path, FILE, 2)
    got = sorted(token_store.directory(sp, path).collect(), key=lambda x: x.key)
    assert [x.ids_crc32 for x in got] == [zlib.crc32(np.array([*i, 2], "<u4").tobytes()) for i in want]
    assert [x.start for x in got] == [sum(len(i) + 1 for i in want[:k]) for k in range(len(want))]


def test_directory_reads_the_index():
    docs = [(None, 3), (None, 1), (-4, 2), (7, 5), (7, 1), (9, 4)]
    row = token_store.shard(0, 0, 2, [k for k, _ in docs], [b"\0\0" * n for _, n in docs])
    keys, ends = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["ends"], "<i8")
    starts, counts = token_store.placed(keys, ends, row["index"])
    assert counts.tolist() == [n for _, n in docs] and starts.tolist() == [0, 3, 4, 6, 11, 12]
    own, first, n = np.array([-4, 7, 9]), np.array([4, 6, 12]), np.array([2, 6, 4])
    for bad in ((own, first + [0, 1, 0], n), (own, first, n + [0, 0, 1]), (own + [0, 0, 1], first, n)):
        with pytest.raises(ValueError):
            token_store.placed(keys, ends, token_store.pack_index(*bad))
