"""Personal data: patterns against plain regular expressions, exact decoding."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paritas.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


@pytest.fixture(scope="module")
def field():
    return pii.train()


def plain(text):
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.-@+0129 (\né", max_size=60))
def test_patterns_on_noise(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["x.y@mail.example.com", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "+1 (555) 010-4477",
                                 "word", "12", "@", "+", "4111-1111-1111-1112", ".", "٣"]), max_size=8), st.sampled_from([" ", "", ", "]))
def test_patterns_on_parts(parts, glue):
    text = glue.join(parts)
    assert pii.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    assert pii.base_spans("a" * 200_000 + "@") == []
    assert pii.base_spans("7" * 200_000) == [] and pii.base_spans("9" * 5000 + ".1.1.1") == []


def test_viterbi_is_exact(field):
    rng = np.random.default_rng(3)
    emits = [rng.normal(size=(n, len(pii.LABELS))) * 3 for n in (1, 3, 2, 4, 1, 3)]
    for e, got in zip(emits, pii.viterbi(field, emits, cells=5)):
        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(e)), key=lambda y: field.first[y[0]] + e[0, y[0]] + sum(
            field.step[a, b] + e[t + 1, b] for t, (a, b) in enumerate(zip(y, y[1:]))))
        assert tuple(got) == best


def test_field_reads_its_table(field):
    wrong = total = 0
    for tokens, labels in pii.labelled_lines():
        for run, gold in pii.labelled_runs(tokens, labels):
            got = pii.viterbi(field, [pii.emissions(field, run)])[0]
            wrong += int((got != np.array(gold)).sum())
            total += len(gold)
    assert wrong <= 0.02 * total


def test_added_spans_and_redaction(field):
    text = "Ring (555) 010-4477 or mail x@y.example.com, not 12 of 2019.\nIP 10.9.8.7!"
    base, more = pii.find([text], field)[0]
    assert [text[s:e] for s, e, _ in base] == ["x@y.example.com", "10.9.8.7"] and [text[s:e] for s, e, _ in more] == ["(555) 010-4477"]
    assert pii.redact(text, base + more) == "Ring [PHONE] or mail [EMAIL], not 12 of 2019.\nIP [IP]!"
    assert pii.redact("abcdef", [(1, 4, 0), (2, 5, 3)]) == "a[EMAIL]f"


def test_any_number_of_blanks(field):
    """Blanks between tokens do not matter, a line break does."""
    for blanks in (1, 2, 9, 60, 5000):
        text = "phone " + (" " * blanks).join(["555", "010", "4477"]) + " x"
        [(base, added)] = pii.find([text], field)
        assert not base and [text[a:b].split() for a, b, _ in added] == [["555", "010", "4477"]]
    assert len(pii.text_runs("555 \n 010")) == 2


def test_clean_prose_gets_nothing(field):
    assert pii.find(["In 2019 the 3 of them paid 12.50 for version 4.0."], field)[0] == ([], [])


def test_spark_results(sp, field):
    df = sp.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "é a@b.example 1.2.3.4", "x"), (3, "é a@b.example 1.2.3.4", "x")],
                            "doc_id bigint, text string, spans string")
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.spans, r.base_sha256, r.redacted) for r in pii.detected(df, field).collect())
    spans = "email:2:13,ip:14:21"
    one = (3, 1, 1, spans, hashlib.sha256(spans.encode()).hexdigest(), "é [EMAIL] [IP]")
    none = hashlib.sha256(b"").hexdigest()
    assert got == [(1, 0, 0, "", none, None), (2, 0, 0, "", none, ""), one, one]
    assert pii.detected(df.limit(0), field).count() == 0
    assert pii.redacted(df, field).columns == df.columns


def test_features_read_the_whole_token():
    """Letters collapse, so a token's length alone changes no shape feature."""
    for end in ("@site.example.org", "12-345-6789", "/x:%", ".b.c.d"):
        assert pii.token_features("a" * 5000 + end) == pii.token_features("aa" + end)
    assert "letters=True" in pii.token_features("-." * 5000 + "x")
