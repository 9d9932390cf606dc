"""DuckDB SQL of the queries that SQL can express, written independently."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Line, window and character measurements by unnesting, not by the code's own path.
ORACLE["op2_rule_ledger"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
base AS (
  SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims,
    CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_ascii,
    CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes,
    CAST(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS BIGINT) AS n_plain
  FROM d),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
win AS (
  SELECT a.doc_id, a.i, count(*) OVER (PARTITION BY a.doc_id, a.w, b.w, c.w) AS n
  FROM words a JOIN words b ON b.doc_id = a.doc_id AND b.i = a.i + 1
  JOIN words c ON c.doc_id = a.doc_id AND c.i = a.i + 2),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM win, (VALUES (0), (1), (2)) t(k) WHERE n >= 2 GROUP BY doc_id),
m AS (
  SELECT base.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_ascii + (n_bytes - n_plain) AS n_letters
  FROM base LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, CAST(
      (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_upper > 3 * n_letters THEN 16 ELSE 0 END)
    + (CASE WHEN 10 * n_exclaims > n_words THEN 32 ELSE 0 END)
    + (CASE WHEN word_chars > 12 * n_words OR word_chars < 2 * n_words THEN 64 ELSE 0 END)
    + (CASE WHEN 10 * n_letters < 4 * n_bytes THEN 128 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, fail_bits,
  (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept
FROM f
"""

# Water filling level by level: a child's share is found by trying every number
# of exhausted children in order of capacity per weight.
def _level(parent: str, child: str, cols: str, up: str, path: str) -> str:
    same = " AND ".join(f"n.{c} IS NOT DISTINCT FROM u.{c}" for c in cols.split(", ")[:-1]) or "TRUE"
    part = ", ".join(f"n.{c}" for c in cols.split(", ")[:-1]) or "1"
    return f"""
{child}_n AS (
  SELECT {cols}, CAST(sum(tokens) * 4 AS DOUBLE) AS cap, sum(tokens) AS tokens, sum(docs) AS docs,
    coalesce(max(w.weight), 1.0) AS weight
  FROM leaves LEFT JOIN weights w ON w.path = {path} GROUP BY {cols}),
{child}_r AS (
  SELECT n.*, u.target AS budget,
    coalesce(sum(n.cap) OVER (PARTITION BY {part} ORDER BY n.cap / n.weight, {", ".join("n." + c for c in cols.split(", "))}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(n.weight) OVER (PARTITION BY {part} ORDER BY n.cap / n.weight, {", ".join("n." + c for c in cols.split(", "))}
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM {child}_n n JOIN {up} u ON {same}),
{child} AS (
  SELECT n.*, round(least(n.cap, n.weight * greatest(coalesce(
      max(CASE WHEN n.cap / n.weight > (n.budget - n.used) / n.rest THEN (n.budget - n.used) / n.rest END)
        OVER (PARTITION BY {part}), 1e300), 0)), 6) AS target
  FROM {child}_r n)"""


ORACLE["op1_source_mixture"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, source, 'd' || (CAST(regexp_extract(source, '[0-9]+$') AS BIGINT) % 4) AS domain,
    CAST(len({_WORDS}) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens, count(*) AS docs FROM d GROUP BY ALL),
weights AS (
  SELECT a.d AS path, CAST(a.w AS DOUBLE) AS weight FROM (VALUES ('d0', 4), ('d1', 3), ('d2', 2), ('d3', 1)) a(d, w)
  UNION ALL
  SELECT a.d || '/' || l.l, CAST(l.w AS DOUBLE) FROM (VALUES ('d0'), ('d1'), ('d2'), ('d3')) a(d),
    (VALUES ('en', 5), ('de', 2), ('fr', 2), ('es', 1)) l(l, w)),
root AS (SELECT CAST(floor(sum(tokens) * 1.2) AS DOUBLE) AS target FROM leaves),
{_level("root", "dom", "domain", "root", "domain")},
{_level("dom", "lng", "domain, lang", "dom", "domain || '/' || lang")},
{_level("lng", "src", "domain, lang, source", "lng", "domain || '/' || lang || '/' || source")},
plan AS (
  SELECT domain, lang, source, tokens AS all_tokens, CAST(floor(target) AS BIGINT) AS budget,
    CAST(floor(floor(target) / tokens) AS INTEGER) AS whole FROM src WHERE tokens > 0),
o AS (
  SELECT d.*, whole, budget - whole * all_tokens AS rest,
    coalesce(sum(tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('7:' || whole || ':' || doc_id)
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch, tokens,
  CAST(CASE WHEN e < whole THEN tokens ELSE least(tokens, rest - start) END AS BIGINT) AS taken_tokens
FROM o, (SELECT unnest(range(0, 5)) AS e) t WHERE e < whole OR (e = whole AND start < rest)
"""

# The mail quotes whole turns, so what a message quotes is known without parsing:
# the turn before (level 1) and the one before that (level 2).
ORACLE["op3_quotation_threads"] = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, text, trim(lower(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM conversations),
said AS (SELECT conv_id, turn, min(text) AS text FROM m GROUP BY ALL),
q AS (
  SELECT a.conv_id, a.turn, k AS level, trim(lower(regexp_replace(b.text, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
  FROM (SELECT DISTINCT conv_id, turn FROM m) a, (VALUES (1), (2)) v(k)
  JOIN said b ON b.conv_id = a.conv_id AND b.turn = a.turn - k),
l AS (
  SELECT q.*, coalesce(
    (SELECT min({'c': m.conv_id, 't': m.turn}) FROM m WHERE m.norm = q.norm AND m.conv_id = q.conv_id AND m.turn < q.turn),
    (SELECT CASE WHEN min({'c': m.conv_id, 't': m.turn}) < {'c': q.conv_id, 't': q.turn} THEN min({'c': m.conv_id, 't': m.turn}) END
     FROM m WHERE m.norm = q.norm)) AS original FROM q),
p AS (
  SELECT conv_id, turn, count(*) AS n_quoted, count(original) AS n_linked,
    arg_min(original, level) FILTER (original IS NOT NULL) AS parent FROM l GROUP BY ALL),
k AS (SELECT DISTINCT m.conv_id, m.turn, p.parent, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked
      FROM m LEFT JOIN p USING (conv_id, turn)),
t AS (
  SELECT conv_id, turn, conv_id AS root_conv, turn AS root_pos, CAST(0 AS BIGINT) AS depth FROM k WHERE parent IS NULL
  UNION ALL
  SELECT k.conv_id, k.turn, t.root_conv, t.root_pos, t.depth + 1 FROM k JOIN t ON k.parent.c = t.conv_id AND k.parent.t = t.turn)
SELECT m.conv_id, m.turn, t.root_conv, t.root_pos, t.depth, k.parent.c AS parent_conv, k.parent.t AS parent_pos,
  CAST(n_quoted AS BIGINT) AS n_quoted, CAST(n_linked AS BIGINT) AS n_linked, md5(trim(m.text)) AS own_text
FROM m JOIN k USING (conv_id, turn) JOIN t USING (conv_id, turn)
"""

ORACLE["op8_pivot_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

# Levels by recursion over runs of eight, proofs by joining each leaf to its runs,
# folding by a list reduction; the checksum bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, len({0}) + 1), lambda i: CAST(ord({0}[i]) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_FIELDS = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS id, doc_id, lang, {_FIELD.format('lang')} AS g,
    sha256({_FIELDS} || {_FIELD.format('text')}) AS leaf,
    CASE WHEN {_CRC.format('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN
      sha256({_FIELDS} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS tampered
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, tampered NULLS FIRST, id) - 1 AS pos,
    count(*) OVER (PARTITION BY g) AS n FROM leaves),
lv AS (
  SELECT 0 AS level, g, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT level + 1, g, pos // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM lv WHERE n > 1 GROUP BY level, g, pos // 8),
subroots AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM lv JOIN (SELECT DISTINCT g, lang FROM leaves) USING (g) WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY level, pos // 8),
steps AS (
  SELECT p.id, v.level, v.pos AS sib, (p.pos >> (3 * v.level)) AS own, v.h
  FROM placed p JOIN lv v ON v.g = p.g AND v.n > 1 AND v.pos // 8 = p.pos >> (3 * v.level + 3)
  UNION ALL
  SELECT p.id, 100 + t.level, t.pos, s.pos >> (3 * t.level), t.h
  FROM placed p JOIN subroots s USING (g) JOIN top t ON t.n > 1 AND t.pos // 8 = s.pos >> (3 * t.level + 3)),
sides AS (
  SELECT id, level, coalesce(string_agg(h, '' ORDER BY sib) FILTER (WHERE sib < own), '') AS l,
    coalesce(string_agg(h, '' ORDER BY sib) FILTER (WHERE sib > own), '') AS r
  FROM steps GROUP BY id, level),
paths AS (
  SELECT id, string_agg(l || r, '' ORDER BY level) AS beside, list(l || '*' || r ORDER BY level) AS path FROM sides GROUP BY id),
done AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(beside, '')) AS proof_sha256,
    list_reduce(list_concat([coalesce(tampered, leaf)], coalesce(path, [])), lambda a, b: sha256(replace(b, '*', a))) AS folded_root
  FROM placed JOIN subroots USING (g) LEFT JOIN paths USING (id))
SELECT *, folded_root = root AS verified FROM done
"""

# Phrases by joining words of a piece with their followers; exact in 128-bit integers.
ORACLE["op13_collocations"] = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, g, p FROM (
    SELECT coalesce(lang, 'und') AS g, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
lists AS (SELECT piece, g, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
tokens AS (SELECT piece, g, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM lists),
three AS (
  SELECT g, w AS w1, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM tokens WINDOW p AS (PARTITION BY piece ORDER BY i)),
f1 AS (SELECT g, w1, count(*) AS f FROM three GROUP BY ALL),
f2 AS (SELECT g, w1, w2, count(*) AS f FROM three WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT g, w1, w2, w3, count(*) AS f FROM three WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT g, sum(f) AS n FROM f1 GROUP BY g),
cuts AS (
  SELECT x.g, x.w1 || ' ' || x.w2 AS phrase, x.f AS a, 1 AS k, a.f AS l, b.f AS r FROM f2 x
  JOIN f1 a ON a.g = x.g AND a.w1 = x.w1 JOIN f1 b ON b.g = x.g AND b.w1 = x.w2
  WHERE x.f >= 10 AND NOT EXISTS (SELECT 1 FROM f3 y WHERE y.g = x.g AND 100 * y.f >= 50 * x.f
    AND ((y.w1 = x.w1 AND y.w2 = x.w2) OR (y.w2 = x.w1 AND y.w3 = x.w2)))
  UNION ALL
  SELECT x.g, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 1, a.f, b.f FROM f3 x
  JOIN f1 a ON a.g = x.g AND a.w1 = x.w1 JOIN f2 b ON b.g = x.g AND b.w1 = x.w2 AND b.w2 = x.w3
  UNION ALL
  SELECT x.g, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 2, a.f, b.f FROM f3 x
  JOIN f2 a ON a.g = x.g AND a.w1 = x.w1 AND a.w2 = x.w2 JOIN f1 b ON b.g = x.g AND b.w1 = x.w3),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY g, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest)
SELECT g AS lang, rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, score FROM ranked JOIN n USING (g) WHERE rank <= 2000
"""
