"""Personal data: fixed patterns plus a linear-chain conditional random field.

The patterns give the base spans. The field labels whitespace tokens from
their shapes (letters, digits and punctuation, never the words themselves)
and adds what the patterns miss: phone numbers without ``+``, spaced numbers,
addresses with brackets. A token with neither a digit nor ``@`` can only be
labelled "outside"; this is part of the model, in training and decoding, so a
text falls apart into short runs of other tokens (blanks between them don't
matter, line breaks end a run), and only these are decoded, exactly and many at
a time (Viterbi over padded numpy batches).

Defined results: null and empty texts have no spans; repeated rows are read
one by one; ties between equal Viterbi scores go to the label listed first;
other columns are neither read nor returned; an empty table gives an empty
result. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

Span = tuple[int, int, int]  # start, end, index of the kind

# ---------------------------------------------------------------- base patterns

HINT_RE = re.compile(r"[0-9@]")
LOCAL_RE = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN_RE = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED_RE = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD_RE = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their ``@`` so that the work is linear."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL_RE.match(text, start - 1):
            start -= 1
        m = DOMAIN_RE.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Every four parts of a dotted run of numbers, from its left."""
    for m in DOTTED_RE.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD_RE.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE_RE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(s, e, 0) for s, e in emails(text)]
    for k, f in ((1, addresses), (2, cards), (3, phones)):
        found += [(s, e, k) for s, e in f(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


# ---------------------------------------------------------------- the field

RUN_RE = re.compile(r"[^\x20\x09-\x0D]+")


def shape(token: str) -> str:
    """Letters as a, digits as d, runs of letters and digits collapsed."""
    return re.sub(r"a+", "a", re.sub(r"[0-9]+", "d", re.sub(r"[^\W\d_]", "a", token)))


def bucket(n: int) -> str:
    for top in (0, 2, 3, 4, 6, 8, 11, 12, 15, 19):
        if n <= top:
            return str(top)
    return "more"


@cache
def _coarse(sh: str) -> str:
    core = sh.strip("()[]<>.,;:!?\"'")
    return core if len(core) <= 8 else "long"


def token_features(token: str) -> list[str]:
    """Shape features of one token, for itself (its neighbours see the last)."""
    sh = shape(token)
    core = _coarse(sh) if len(sh) <= 200 else _coarse.__wrapped__(sh)  # long shapes are not worth keeping
    digits = sum("0" <= c <= "9" for c in token)
    parts = [len(x) for x in re.findall(r"[0-9]+", token)]
    return [f"core={core}", f"digits={bucket(digits)}",
            f"parts={'-'.join(map(str, parts[:5])) if max(parts, default=0) <= 5 and len(parts) <= 5 else 'x'}",
            f"at={token.count('@') if token.count('@') < 2 else 2}", f"plus={token.lstrip('(').startswith('+')}",
            f"letters={'a' in sh}", f"slash={'/' in sh or ':' in sh.rstrip(':') or '%' in sh or '$' in sh}",
            f"dots={min(core.count('.'), 4)}|{'a' in sh}", core]


#: The labelled table: lines with marked spans, [kind|text]. Fixed values.
LABELLED = """
write to [email|ann.lee@mail.example.org] before noon
my address is [email|<bob_77@site.example.com>] thanks
contact: [email|x@localhost] or the desk
see [email|(carla@uni.example.edu),] room 12
[email|max@firma-haus.de] und [email|eva@haus]
send it to [email|josé@correo.example.es] today
reply [email|info@büro.example.de] soon
call [phone|+1 555 010 4477] now
call [phone|+44 20 7946 0958] after 5
tel [phone|(555) 010-4477] ext 12
tel: [phone|555-010-4477] or [phone|555 010 4477]
phone [phone|(030) 901820-44] in 2 days
ring [phone|555.010.4477] at 9
fax [phone|0049 30 901820] please
mobile [phone|0171 5550104] or mail [email|a.b@c.example.net]
dial [phone|+33 1 70 18 99 00] or 112
whatsapp [phone|(+34) 600 123 456] only
the number [phone|020 7946 0958] is ours
host [ip|10.0.0.12] answered
from [ip|192.168.1.44:8080] at 10:22
[ip|172.16.254.1/24] is the subnet
ping [ip|8.8.8.8,] then wait
server [ip|(203.0.113.7)] is down
ip [ip|198.51.100.23;] port 443
card [card|4111 1111 1111 1111] exp 12/27
paid with [card|4111-1111-1111-1111] today
[card|5500 0000 0000 0004] was charged 20.50
number [card|378282246310005] cvv 123
card [card|6011000990139424,] thanks
visa [card|4012 8888 8888 1881.] ok
in 2019 there were 14 of them
version 4.0 of the licence
chapter 3.2.1 on page 118
it costs $12.50 or 1,250.00 in total
on 2021-05-17 at 14:30:00 we met
the 3rd and 4th of 12/05/1998
between 1,000,000 and 2,500,000 people
room 12 34 and 56
see section 10.4 and table 7
a ratio of 3:1 or 75% of 80
isbn 978-3-16-148410-0 printed 2004
build 20230117 commit 7f3a9c2e
4 8 15 16 23 42
id 123456 order 99817 items 3
0.25 0.50 0.75 1.00
1998 1999 2000 2001 2002
key = 1eb9c654e721b4f812088970e66a6345cee33dd6
model x200 and r2d2 units
password=7602ad27cf5550de1c is set
password=b7db7aa4a5fcc78305 here
token=9f86d081884c7d659a2f was sent
@home and @work are tags
meet @ 5 pm
cost @ 12.50 each for 100
error 404 at line 1203
3.14159 and 2.71828
the years 1914-1918 and 1939-1945
pages 100-120 and 200-240
python3.13 and utf8
19. the first 20. the second
1. one 2. two 3. three
a=1 b=2 c=30
12,5 kg und 3,75 m
"""


def labelled_lines() -> list[tuple[list[str], list[str]]]:
    """Tokens and labels of the labelled table."""
    out = []
    for line in filter(None, LABELLED.split("\n")):
        tokens, labels = [], []
        for m in re.finditer(r"\[(\w+)\|(.*?)\](?=\s|$)|(\S+)", line):
            words = (m[2] or m[3]).split()
            tokens += words
            labels += [f"{'I' if i else 'B'}-{m[1]}" if m[1] else "O" for i in range(len(words))]
        out.append((tokens, labels))
    return out


def candidate(token: str) -> bool:
    return bool(HINT_RE.search(token))


def labelled_runs(tokens: list[str], labels: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Maximal runs of candidate tokens with their labels."""
    i = 0
    while i < len(tokens):
        if not candidate(tokens[i]):
            i += 1
            continue
        j = i
        while j < len(tokens) and candidate(tokens[j]):
            j += 1
        yield tokens[i:j], [LABELS.index(x) for x in labels[i:j]]
        i = j


@dataclass(frozen=True)
class Field:
    index: dict[str, int]
    weights: np.ndarray     # features x labels
    step: np.ndarray        # labels x labels
    first: np.ndarray       # labels


def allowed_steps() -> np.ndarray:
    """0 where a label may follow another, -inf where I- has no B- or I- before."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            if b[0] == "I" and a[2:] != b[2:]:
                out[i, j] = -np.inf
    return out


def run_features(tokens: list[str]) -> list[list[str]]:
    own = [token_features(t) for t in tokens]
    out = []
    for i, f in enumerate(own):
        before = own[i - 1][-1] if i else "none"
        after = own[i + 1][-1] if i + 1 < len(own) else "none"
        out.append([*f[:-1], f"before={before}", f"after={after}", f"pair={before}|{f[-1]}", f"next={f[-1]}|{after}"])
    return out


def train(steps: int = 300, rate: float = 0.1, l2: float = 0.02) -> Field:
    """Penalised maximum likelihood on the labelled table: forward-backward
    over all runs at once, Adam."""
    seqs = [(run_features(t), y) for tokens, labels in labelled_lines() for t, y in labelled_runs(tokens, labels)]
    index: dict[str, int] = {}
    for feats, _ in seqs:
        for f in feats:
            for name in f:
                index.setdefault(name, len(index))
    n, top, k = len(seqs), max(len(y) for _, y in seqs), len(LABELS)
    width = len(seqs[0][0][0])
    ids = np.zeros((n, top, width), dtype=np.int64)
    gold = np.zeros((n, top), dtype=np.int64)
    size = np.array([len(y) for _, y in seqs])
    for i, (feats, y) in enumerate(seqs):
        for t, f in enumerate(feats):
            ids[i, t] = [index[x] for x in f]
        gold[i, :len(y)] = y
    on = np.arange(top)[None, :] < size[:, None]
    block = allowed_steps()
    start_block = np.array([-np.inf if x[0] == "I" else 0.0 for x in LABELS])
    params = np.zeros(len(index) * k + k * k + k)
    m, v = np.zeros_like(params), np.zeros_like(params)
    cut1, cut2 = len(index) * k, len(index) * k + k * k

    def lse(x, axis):
        peak = np.max(x, axis=axis, keepdims=True)
        peak = np.where(np.isfinite(peak), peak, 0.0)
        with np.errstate(divide="ignore"):
            return np.squeeze(np.log(np.sum(np.exp(x - peak), axis=axis, keepdims=True)) + peak, axis)

    for it in range(1, steps + 1):
        w, tr, st = params[:cut1].reshape(-1, k), params[cut1:cut2].reshape(k, k) + block, params[cut2:] + start_block
        emit = w[ids].sum(axis=2)
        fwd = np.full((n, top, k), -np.inf)
        bwd = np.zeros((n, top, k))
        fwd[:, 0] = st + emit[:, 0]
        for t in range(1, top):
            fwd[:, t] = np.where(on[:, t, None], lse(fwd[:, t - 1, :, None] + tr[None], 1) + emit[:, t], -np.inf)
        for t in range(top - 2, -1, -1):
            nxt = lse(tr[None] + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(on[:, t + 1, None], nxt, 0.0)
        total = lse(fwd[np.arange(n), size - 1], 1)
        prob = np.where(on[:, :, None], np.exp(fwd + bwd - total[:, None, None]), 0.0)
        d_emit = prob.copy()
        rows, cols = np.nonzero(on)
        d_emit[rows, cols, gold[rows, cols]] -= 1
        g = np.zeros_like(params)
        gw = g[:cut1].reshape(-1, k)
        np.add.at(gw, ids[rows, cols].ravel(), np.repeat(d_emit[rows, cols], width, axis=0))
        gt = g[cut1:cut2].reshape(k, k)
        for t in range(1, top):
            live = on[:, t]
            pair = np.exp(fwd[live, t - 1, :, None] + tr[None] + (emit[live, t] + bwd[live, t])[:, None, :]
                          - total[live, None, None])
            gt += pair.sum(axis=0)
            np.add.at(gt, (gold[live, t - 1], gold[live, t]), -1)
        gs = g[cut2:]
        gs += prob[:, 0].sum(axis=0)
        np.add.at(gs, gold[:, 0], -1)
        g += l2 * params
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params -= rate * (m / (1 - 0.9 ** it)) / (np.sqrt(v / (1 - 0.99 ** it)) + 1e-8)
    return Field(index, params[:cut1].reshape(-1, k).copy(), params[cut1:cut2].reshape(k, k) + block,
                 params[cut2:] + start_block)


def emissions(field: Field, tokens: list[str]) -> np.ndarray:
    out = np.zeros((len(tokens), len(LABELS)))
    for i, f in enumerate(run_features(tokens)):
        known = [field.index[x] for x in f if x in field.index]
        if known:
            out[i] = field.weights[known].sum(axis=0)
    return out


def viterbi(field: Field, emits: list[np.ndarray], cells: int = 200_000) -> list[np.ndarray]:
    """Best label sequences of many runs: padded blocks of similar length."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(emits)
    order = sorted((i for i, e in enumerate(emits) if len(e)), key=lambda i: len(emits[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(emits[order[end]]) <= cells:
            end += 1
        block = order[at:end]
        at = end
        size = np.array([len(emits[i]) for i in block])
        top = size.max()
        e = np.zeros((len(block), top, len(LABELS)))
        for r, i in enumerate(block):
            e[r, :size[r]] = emits[i]
        best, back = field.first + e[:, 0], np.zeros(e.shape, dtype=np.int8)
        final = best.copy()
        for t in range(1, top):
            through = best[:, :, None] + field.step[None]
            back[:, t] = through.argmax(axis=1)
            best = np.take_along_axis(through, back[:, t, None, :].astype(np.int64), 1)[:, 0] + e[:, t]
            final[size - 1 == t] = best[size - 1 == t]
        path = np.zeros((len(block), top), dtype=np.int64)
        path[np.arange(len(block)), size - 1] = final.argmax(axis=1)
        for t in range(top - 1, 0, -1):
            live = size - 1 >= t
            path[live, t - 1] = back[live, t, path[live, t]]
        for r, i in enumerate(block):
            out[i] = path[r, :size[r]]
    return out


EDGE = "()[]<>{}.,;:!?\"'|"


def text_runs(text: str) -> list[list[tuple[int, int]]]:
    """Token offsets of the maximal runs of candidate tokens, line by line: any
    number of blanks may lie between two tokens of a run, a line break may not."""
    out: list[list[tuple[int, int]]] = []
    done, last_end, n = 0, -1, len(text)
    for m in HINT_RE.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > 0 and text[start - 1] not in " \t\n\r\x0b\x0c":
            start -= 1
        end = RUN_RE.match(text, m.start()).end() if m.start() < n else n
        gap = text[last_end:start] if last_end >= 0 else "\n"
        if out and gap.strip(" \t") == "":
            out[-1].append((start, end))
        else:
            out.append([(start, end)])
        done = last_end = end
    return out


def added_spans(text: str, where: list[list[tuple[int, int]]], labels: list[np.ndarray],
                base: list[Span]) -> list[Span]:
    """Spans of the field that touch no base span, edge punctuation removed."""
    found: list[Span] = []
    for tokens, y in zip(where, labels, strict=True):
        i = 0
        while i < len(y):
            if not y[i]:
                i += 1
                continue
            j = i + 1
            while j < len(y) and LABELS[y[j]][0] == "I":
                j += 1
            start, end = tokens[i][0], tokens[j - 1][1]
            while start < end and text[start] in EDGE and not (text[start] == "(" and ")" in text[start:end]):
                start += 1
            while end > start and text[end - 1] in EDGE:
                end -= 1
            if start < end:
                found.append((start, end, KINDS.index(LABELS[y[i]][2:])))
            i = j
    if not found or not base:
        return found
    starts = np.array([s for s, _, _ in base])
    reach = np.maximum.accumulate(np.array([e for _, e, _ in base]))
    return [x for x in found if (k := int(np.searchsorted(starts, x[1]))) == 0 or reach[k - 1] <= x[0]]


def find(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    base, where, owner, all_runs = [], [], [], []
    for i, t in enumerate(texts):
        hit = HINT_RE.search(t)
        base.append(base_spans(t) if hit else [])
        for r in text_runs(t) if hit else []:
            owner.append(i)
            all_runs.append(r)
    emits = [emissions(field, [texts[o][s:e] for s, e in r]) for o, r in zip(owner, all_runs, strict=True)]
    labels = viterbi(field, emits)
    per: list[tuple[list, list]] = [([], []) for _ in texts]
    for o, r, y in zip(owner, all_runs, labels, strict=True):
        per[o][0].append(r)
        per[o][1].append(y)
    return [(b, added_spans(t, w, y, b) if w else []) for t, b, (w, y) in zip(texts, base, per, strict=True)]


def redact(text: str, spans: list[Span]) -> str:
    """Every span replaced by its kind in brackets; overlapping spans as one."""
    out, at, i = [], 0, 0
    spans = sorted(spans, key=lambda x: (x[0], x[2]))
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]


COUNTS = ("n_email", "n_ip", "n_card", "n_phone")


def detected(df: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, counts of the base spans per kind, ``base_sha256`` of the base
    spans, ``spans`` (base and added), ``n_added`` and the redacted text."""
    kind = df.schema[key].dataType.simpleString()
    names = ["row_key", *COUNTS, "base_sha256", "spans", "n_added", "redacted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            got = find([t or "" for t in raw], field)
            cols = [[sum(x[2] == k for x in base) for base, _ in got] for k in range(len(KINDS))]
            both = [sorted(base + more, key=lambda x: (x[0], x[2])) for base, more in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols),
                 pa.array([hashlib.sha256(span_text(base).encode()).hexdigest() for base, _ in got], pa.string()),
                 pa.array(list(map(span_text, both)), pa.string()),
                 pa.array([len(more) for _, more in got], pa.int64()),
                 pa.array([None if t is None else redact(t, s) for t, s in zip(raw, both, strict=True)],
                          b.column(1).type)], names)

    schema = (f"row_key {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS)
              + ", base_sha256 string, spans string, n_added bigint, redacted string")
    return df.select(F.col(key).alias("row_key"), F.col(text).alias("row_text")) \
        .mapInArrow(run, schema).withColumnRenamed("row_key", key)


def redacted(df: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``df`` with all personal data in ``text`` replaced; null stays null."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(at).to_pylist()
            got = find([t or "" for t in raw], field)
            new = [None if t is None else redact(t, base + more) for t, (base, more) in zip(raw, got, strict=True)]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.column(at).type))

    return df.mapInArrow(run, df.schema)
