"""Rule ledger: measurements against a plain count, policies and ablations."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from paritas.llm import rules

TEXT = st.text(alphabet="ab \n\t\x0b#!Aé  ", max_size=60)


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    win = list(zip(words, words[1:], words[2:]))
    count = Counter(win)
    rep = {i + k for i, w in enumerate(win) if count[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), dup, len(rep))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_measurements(text):
    assert rules.measure(text)[:6] == plain(text)


def test_many_distinct_words_use_the_wide_key():
    words = [b"w%d" % i for i in range(1 << 20)]
    assert rules.repeated_words(words + words[:3]) == 6


def test_ledger_and_policies(sp):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, 5), (2, None, 5), (3, "", 5), (4, "x y z " * 40, 5), (5, good + " #" * 20, 5), (1, good, 5)]
    df = sp.createDataFrame(rows, "doc_id bigint, text string, n_words int")
    got = rules.ledger(df).withColumn("ok", rules.passes("v2")).collect()
    assert sorted((r.doc_id, r.n_words, r.fail_bits, r.ok) for r in got) == [
        (1, 60, 0, True), (1, 60, 0, True), (2, 0, 1, False), (3, 0, 1, False), (4, 120, 66, False), (5, 80, 4, False)]  # 66: repeated words, and words of one letter
    ab = {(r.version, r.rule): r for r in rules.ablation(rules.ledger(df)).collect()}
    assert ab["v2", "many_symbols"].n_only == 1 and ab["v2", "many_symbols"].n_kept_without == 3
    assert ab["base", "too_few_words"].n_failed == 2 and ab["base", "repeated_words"].n_docs == 6
    assert set(ab) == {(v, r) for v in rules.POLICIES for r in rules.POLICIES[v]}


def test_empty_table(sp):
    df = sp.createDataFrame([], "doc_id bigint, text string")
    assert rules.ledger(df).count() == 0 and rules.ablation(rules.ledger(df)).count() == 0
