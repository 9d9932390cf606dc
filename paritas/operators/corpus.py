"""Bulk jobs over a corpus of scripts.

Input is a DataFrame of whole texts (``spark.read.text(path, wholetext=True)``
or ``binaryFile``), one row per script. Everything is a column expression or a
join; nothing loops over files on the
driver, and every text is processed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.functions.sas import WHITESPACE
from paritas.session import ensure_checkpoint_dir

# The patterns that define the script semantics (Java regex; U:
# \w, \s and \b know all of Unicode, as the semantics ask for).
INCLUDE_RE = r"""(?iU)%include\s+['"]([^'"]+)['"]\s*;"""
LET_RE = r"(?imdU)^\s*%let\s+(\w+)\s*=\s*([^;]*);\s*$"
BLOCK_COMMENT_RE = r"(?s)/\*.*?\*/"
STEP_START_RE = r"(?iU)^\s*(data\b(?!\s*=)|proc\s+\w+|%macro\b)"
STEP_END_RE = r"(?iU)^\s*(run|quit)\s*;"
MACRO_END_RE = r"(?iU)^\s*%mend\b.*;"
# Line breaks as Python's str.splitlines() knows them.
LINE_BREAK_RE = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

SQL_WRITE_RE = (r"(?iU)\b(?:create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)"
                r"(?:\s+if\s+not\s+exists)?|replace\s+table|insert\s+(?:into|overwrite)"
                r"(?:\s+table)?|merge\s+into|update|delete\s+from|alter\s+table"
                r"|drop\s+table(?:\s+if\s+exists)?|truncate\s+table)"
                r"\s+([\w.]+)")
PY_WRITE_RE = r"""(?U)\.(?:saveAsTable|insertInto|writeTo)\(\s*[rbfuRBFU]{0,2}['"]([^'"]+)['"]"""
FORBIDDEN_RE = (r"(?iU)\b(?:use\s+(?:catalog\s+|schema\s+|database\s+)?\w|"
                r"(?:drop|create)\s+(?:schema|database)\b|"
                r"insert\s+overwrite\s+(?:local\s+)?directory\b)")
PY_FORBIDDEN_RE = r"(?U)\.set(?:CurrentDatabase|CurrentCatalog)\s*\("

# What the write scan takes out: line comments, block comments, blanks around dots.
LINE_COMMENT_RE = r"--[^\n]*"
SCAN_COMMENT_RE = r"(?s)/\*.*?\*/"
DOT_RE = r"(?U)\s*\.\s*"

JSON_BLOCK_RE = r"(?s)```json\s*\n(.*?)```(.*)"
CODE_BLOCK_RE = r"(?s)```(sql|python|pyspark)\s*\n(.*?)```"
HEADER_SCHEMA = "language string, inputs array<string>, outputs array<string>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strip(c: Column) -> Column:
    """Python ``str.strip()``: every Unicode whitespace character, both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def _count(c: Column, s: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))


def _splice(pieces: Column, fills: Column) -> Column:
    """pieces[0] + fills[0] + pieces[1] + ... (len(pieces) == len(fills) + 1)."""
    tail = F.zip_with(fills, F.slice(pieces, 2, F.size(pieces)),
                      lambda f, p: F.concat(F.coalesce(f, F.lit("")), p))
    return F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))


# ---------------------------------------------------------------- T1

def strip_block_comments(src) -> Column:
    """Remove ``/* ... */`` comments, keeping the newlines they spanned."""
    src = _c(src)
    pieces = F.split(src, BLOCK_COMMENT_RE, -1)
    comments = F.regexp_extract_all(src, F.lit(BLOCK_COMMENT_RE), 0)
    fills = F.transform(comments, lambda m: F.repeat(F.lit("\n"), _count(m, "\n")))
    return _splice(pieces, fills)


# ---------------------------------------------------------------- T3

def _regex_replacement_literal(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\$])", r"\\$1")


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _definitions(names: Column, values: Column) -> Column:
    """``key``, ``i``, ``name`` and ``value`` of each name: its place is that of
    its first definition, its value that of its last one. By sorting, not by
    comparing each with all others."""
    every = F.array_sort(F.transform(names, lambda x, i: F.struct(x.alias("name"), i.alias("i"), F.get(values, i).alias("value"))))

    def per_name(s: Column) -> Column:
        first = F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["name"] != x["name"]))
        last = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["name"] != x["name"]))
        return F.zip_with(first, last, lambda f, x: F.struct(
            _ascii_lower(f["name"]).alias("key"), f["i"].alias("i"), f["name"].alias("name"), _strip(x["value"]).alias("value")))
    return F.array_sort(_with(every, per_name))


def _one_by_one(text: Column, defs: Column) -> Column:
    """Each definition rewrites the whole text: longer names first, then in order."""
    order = F.array_sort(F.transform(defs, lambda d: F.struct((-F.length(d["key"])).alias("n"), d["i"].alias("i"), d["name"].alias("name"),
                                                              d["value"].alias("value"))))
    return F.aggregate(order, text, lambda acc, d: F.regexp_replace(
        acc, F.concat(F.lit("(?i)&"), d["name"], F.lit(r"\.?")), _regex_replacement_literal(d["value"])))


def _length_by_length(text: Column, winners: Column) -> Column:
    """One pass over the text for all names of a length: split at ``&``, the
    front of a piece looked up in the definitions."""
    lengths = F.reverse(F.array_sort(F.array_distinct(F.transform(winners, lambda d: F.length(d["key"])))))
    table = F.map_from_arrays(F.transform(winners, lambda d: d["key"]), F.transform(winners, lambda d: d["value"]))

    def replaced(acc: Column, n: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            rest = F.substr(p, n + 1)
            after = F.when(rest.startswith("."), F.substr(rest, F.lit(2))).otherwise(rest)
            found = F.try_element_at(acc["table"], _ascii_lower(F.substr(p, F.lit(1), n)))
            return F.when(i == 0, p).otherwise(F.coalesce(F.concat(found, after), F.concat(F.lit("&"), p)))
        return F.struct(F.array_join(F.transform(F.split(acc["text"], "&", -1), piece), "").alias("text"), acc["table"].alias("table"))

    return F.aggregate(lengths, F.struct(text.alias("text"), table.alias("table")), replaced)["text"]


def expand_lets(src) -> Column:
    """Expand ``%let`` variables: the last definition of a name wins for the
    whole text, definitions are removed, longer names are substituted first,
    ``&name`` and ``&name.`` are replaced case-insensitively.

    Names of one length are replaced in one pass, so the work is linear in the
    text for each length. Where the result of a replacement could itself become
    a reference to a name of the same length (a reference right after another,
    a value that ends in one or refers to such a name, names that differ only in
    case), definitions are applied one by one instead, which is what the rule says.
    """
    src = _c(src)
    names = F.regexp_extract_all(src, F.lit(LET_RE), 1)
    values = F.regexp_extract_all(src, F.lit(LET_RE), 2)
    base = F.regexp_replace(src, LET_RE, "")

    def expanded(defs: Column) -> Column:
        refers = lambda d: F.contains(d["value"], F.lit("&"))
        winners = F.filter(defs, lambda d, i: (i == 0) | (F.get(defs, i - 1)["key"] != d["key"]))

        def chosen(w: Column) -> Column:
            same_length = lambda d: F.exists(F.regexp_extract_all(d["value"], F.lit(r"(?U)&(\w+)"), 1), lambda r: F.exists(
                w, lambda e: (F.length(e["key"]) == F.length(d["key"])) & (e["key"] != d["key"]) & _ascii_lower(r).startswith(e["key"])))
            may_cascade = (src.rlike(r"(?U)&\w*&") | F.exists(w, lambda d: refers(d) & (d["value"].rlike(r"(?U)&\w*$") | same_length(d)))
                           | ((F.size(w) < F.size(defs)) & F.exists(defs, refers)))
            return F.when(F.size(w) == 0, base).when(may_cascade, _one_by_one(base, defs)).otherwise(_length_by_length(base, w))
        return _with(winners, chosen)
    return _with(_definitions(names, values), expanded)


# ---------------------------------------------------------------- T2

def _dirname(p: Column) -> Column:
    return F.regexp_extract(p, r"^(.*)/[^/]*$", 1)


def normal_path(p: Column) -> Column:
    """A path without ``.``, ``..`` and repeated slashes."""
    segments = F.aggregate(F.split(p, "/", -1), F.array().cast("array<string>"), lambda acc, x: F.when(
        x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.isin("", "."), acc).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.when(p.startswith("/"), "/").otherwise(""), F.array_join(segments, "/"))


def _inline(rows: DataFrame, key: str, targets_to: DataFrame, too_deep: int) -> DataFrame:
    """Inline the direct includes of ``rows`` (``key``, ``_text``) from
    ``targets_to`` (``_tp`` path, ``_tt`` resolved text, ``_th`` height,
    ``_te`` error; every known path, resolved or not). Adds ``_err``,
    ``_maxh`` (longest chain of files below, counting the included file;
    ``too_deep`` or more is an error) and ``_waiting`` (includes whose file
    is known but not resolved yet)."""
    t = rows.select(key, F.posexplode(F.regexp_extract_all("_text", F.lit(INCLUDE_RE), 1))
                    .alias("_pos", "_target"))
    j = t.join(targets_to, normal_path(F.col("_target")) == F.col("_tp"), "left")
    per = j.groupBy(key).agg(
        F.min(F.when(F.col("_tp").isNull(), F.col("_target"))).alias("_missing"),
        F.min("_te").alias("_child_err"),
        F.count_if(F.col("_tp").isNotNull() & F.col("_th").isNull() & F.col("_te").isNull()).alias("_waiting"),
        F.max("_th").alias("_maxh"),
        F.array_sort(F.collect_list(F.struct("_pos", F.col("_tt").alias("t")))).alias("_fills"))
    x = rows.join(per, key)
    h = F.col("_maxh") + 1
    err = (F.when(F.col("_missing").isNotNull(), F.concat(F.lit("include not found: "), F.col("_missing")))
            .when(F.col("_child_err").isNotNull(), F.col("_child_err"))
            .when((F.col("_waiting") == 0) & (F.col("_maxh") >= too_deep),
                  F.lit("%include nesting exceeds max depth")))
    spliced = _splice(F.split("_text", INCLUDE_RE, -1), F.transform("_fills", lambda f: f["t"]))
    return x.select(key, F.when(err.isNull() & (F.col("_waiting") == 0), spliced)
                    .otherwise(F.col("_text")).alias("_text"),
                    err.alias("_err"), F.col("_maxh").alias("_maxh"), "_waiting")


def resolve_includes(programs: DataFrame, files: DataFrame, id_col: str = "program_id",
                     path_col: str = "path", text_col: str = "source",
                     max_depth: int = 10) -> DataFrame:
    """Inline ``%include 'file';`` recursively, relative to the including
    file's folder. ``files`` has ``path, source`` for every includable file.

    Bottom-up: the includable files are resolved among themselves first, one
    join per nesting height over the files that still have open includes
    (checkpointed per height, usually a small table); then every program is
    inlined with one join against the resolved files, so program texts are
    read once and never rewritten per level. A program fails with
    ``include_error`` when a file it reaches is missing ("include not found:
    <smallest missing path>", as written after its folder) or an include chain reaches ``max_depth``
    counting the program (cycles included); its text is then left as read.
    """
    spark = programs.sparkSession
    ensure_checkpoint_dir(spark)
    has_inc = F.col("_text").rlike(INCLUDE_RE)
    # One state table of every includable file: resolved text and height
    # (closed) or still-open includes; one count and one checkpoint per height.
    state = files.select(normal_path(F.col(path_col)).alias("_path"),
                         _absolutize(F.col(text_col), _dirname(F.col(path_col))).alias("_text")) \
        .select("_path", "_text", F.when(~has_inc, F.lit(1)).alias("_h"),
                F.lit(None).cast("string").alias("_err"), has_inc.alias("_open")) \
        .checkpoint(eager=True)
    still_open = None
    for _ in range(max_depth):
        n_open = state.filter("_open").count()
        if n_open == 0 or n_open == still_open:
            break                                  # done, or no progress: a cycle
        still_open = n_open
        targets = state.select(F.col("_path").alias("_tp"), F.col("_text").alias("_tt"),
                               F.when(~F.col("_open"), F.col("_h")).alias("_th"),
                               F.when(~F.col("_open"), F.col("_err")).alias("_te"))
        # A file's own height is 1 + its longest chain: max_depth or more fails.
        step = _inline(state.filter("_open").select("_path", "_text"), "_path", targets, max_depth - 1)
        closed = F.col("_err").isNotNull() | (F.col("_waiting") == 0)
        step = step.select("_path", "_text",
                           F.when(closed & F.col("_err").isNull(), F.col("_maxh") + 1).alias("_h"),
                           "_err", (~closed).alias("_open"))
        state = state.filter(~F.col("_open")).unionByName(step).checkpoint(eager=True)
    resolved = state.select(
        F.col("_path").alias("_tp"), F.col("_text").alias("_tt"), F.col("_h").alias("_th"),
        F.when(F.col("_open"), F.lit("%include nesting exceeds max depth"))
         .otherwise(F.col("_err")).alias("_te"))

    p = programs.select(F.col(id_col).alias("_id"),
                        _absolutize(F.col(text_col), _dirname(F.col(path_col))).alias("_text"))
    plain = p.filter(~has_inc).select("_id", "_text", F.lit(None).cast("string").alias("_err"))
    # The program is level 0: a chain of max_depth files below it fails.
    inlined = _inline(p.filter(has_inc), "_id", resolved, max_depth).select("_id", "_text", "_err")
    return plain.unionByName(inlined).select(
        F.col("_id").alias(id_col), F.col("_text").alias(text_col), F.col("_err").alias("include_error"))


def _absolutize(text: Column, folder: Column) -> Column:
    """Prefix relative include paths in ``text`` with ``folder``."""
    prefix = _regex_replacement_literal(F.concat(folder, F.lit("/")))
    return F.when(F.coalesce(folder, F.lit("")) == "", text).otherwise(
        F.regexp_replace(text, F.lit(r"""(?i)(%include\s+['"])(?=[^/'"])"""),
                         F.concat(F.lit("$1"), prefix)))


# ---------------------------------------------------------------- T4

# Tags in front of a line say what it can do to a step; the texts' own uses of
# these control characters are escaped behind the last one.
_DATA, _PROC, _MACRO, _MEND, _RUN, _LINE, _ESCAPE = "\x00\x01\x02\x03\x04\x05\x06"
_TAGS = _DATA + _PROC + _MACRO + _MEND + _RUN + _LINE
# A macro up to its %mend line, whatever lies between; a data or proc step up to
# its run line or the next start; else the lines up to the next start.
_STEP_RE = (rf"{_MACRO}[^{_MEND}]*+(?:{_MEND}[^{_TAGS}]*+)?+"
            rf"|[{_DATA}{_PROC}][^{_DATA}{_PROC}{_MACRO}{_RUN}]*+(?:{_RUN}[^{_TAGS}]*+)?+"
            rf"|[{_MEND}{_RUN}{_LINE}][^{_DATA}{_PROC}{_MACRO}]*+")


def _escaped(c: Column) -> Column:
    out = F.replace(c, F.lit(_ESCAPE), F.lit(_ESCAPE + "g"))
    for i, tag in enumerate(_TAGS):
        out = F.replace(out, F.lit(tag), F.lit(_ESCAPE + "abcdef"[i]))
    return F.when(c.rlike(f"[{_TAGS}{_ESCAPE}]"), out).otherwise(c)


def _unescaped(c: Column) -> Column:
    out = c
    for i, tag in enumerate(_TAGS):
        out = F.replace(out, F.lit(_ESCAPE + "abcdef"[i]), F.lit(tag))
    return F.when(F.contains(c, F.lit(_ESCAPE)), F.replace(out, F.lit(_ESCAPE + "g"), F.lit(_ESCAPE))).otherwise(c)


def _tagged(line: Column) -> Column:
    """A line behind its tag. No line is two of these at once."""
    start = F.lower(F.regexp_extract(line, STEP_START_RE, 1))
    tag = (F.when(start.startswith("%macro"), _MACRO).when(start.startswith("data"), _DATA).when(start != "", _PROC)
           .when(line.rlike(MACRO_END_RE), _MEND).when(line.rlike(STEP_END_RE), _RUN).otherwise(_LINE))
    return F.concat(tag, line, F.lit("\n"))


def split_steps(df: DataFrame, id_col: str = "program_id", text_col: str = "source") -> DataFrame:
    """Split scripts into ordered steps ``global | data | proc | macro``.

    A DATA/PROC/%MACRO line starts a step (closing the open one) unless a
    macro is open; ``run;``/``quit;`` at line start ends a DATA or PROC step;
    ``%mend`` ends a macro. Blank steps are dropped and the rest numbered from
    0. A script is one row and is split inside it, without a shuffle and in
    time linear in its length: its lines get tags, and one pattern over the
    tags cuts the whole text.
    """
    lines = F.split(_escaped(F.col(text_col)), LINE_BREAK_RE, -1)
    x = df.select(id_col, F.array_join(F.transform(lines, _tagged), "").alias("_t"))
    tag = lambda s: F.substring(s, 1, 1)
    steps = F.transform(F.regexp_extract_all("_t", F.lit(_STEP_RE), 0), lambda s: F.struct(
        F.when(tag(s) == _MACRO, "macro").when(tag(s) == _DATA, "data").when(tag(s) == _PROC, "proc").otherwise("global").alias("kind"),
        _unescaped(_strip(F.translate(s, _TAGS, ""))).alias("code")))
    full = F.filter(steps, lambda z: z["code"] != "")
    return x.select(id_col, F.posexplode(full).alias("step_index", "_s")).select(id_col, "step_index", "_s.kind", "_s.code")


def preprocess(programs: DataFrame, files: DataFrame, id_col: str = "program_id",
               path_col: str = "path", text_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Includes -> lets -> comments -> steps. Returns (steps, expanded texts)."""
    inc = resolve_includes(programs, files, id_col, path_col, text_col)
    expanded = inc.select(id_col, expand_lets(F.col(text_col)).alias(text_col), "include_error")
    stripped = expanded.select(id_col, strip_block_comments(F.col(text_col)).alias(text_col))
    return split_steps(stripped, id_col, text_col), expanded


# ---------------------------------------------------------------- T5

def scan_text(code) -> Column:
    """Normalized text for the write scan: no backticks, no comments,
    qualified names without spaces around the dot."""
    bare = F.replace(_c(code), F.lit("`"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, LINE_COMMENT_RE, " "), SCAN_COMMENT_RE, " "), DOT_RE, ".")


def sandbox_violations(df: DataFrame, id_col: str, code_col: str, schema_col: str) -> DataFrame:
    """Writes outside the sandbox schema and context changes, one row per hit.

    kind ``context``: USE / CREATE or DROP SCHEMA / INSERT OVERWRITE DIRECTORY
    or setCurrentDatabase/Catalog; kind ``write``: a qualified write target
    outside ``<schema>.``. Raw and normalized texts are both scanned, so a
    comment or backtick can never hide a target. No row means allowed; a step
    without a sandbox name may write nowhere. ``at`` is the hit's place in the
    normalized text (else the raw one).
    The texts and regex results are computed once in projections, before the
    array functions and the explode that use them several times.
    """
    code = F.col(code_col)
    texts = df.select(F.col(id_col), F.col(schema_col).alias("_sb"), code.alias("_code"),
                      F.replace(code, F.lit("`"), F.lit("")).alias("_raw"),
                      scan_text(code).alias("_norm"))
    found = texts.select(
        id_col, "_sb", "_raw", "_norm",
        F.array_union(F.array_union(
            F.regexp_extract_all("_raw", F.lit(FORBIDDEN_RE), 0),
            F.regexp_extract_all("_norm", F.lit(FORBIDDEN_RE), 0)),
            F.regexp_extract_all("_code", F.lit(PY_FORBIDDEN_RE), 0)).alias("_ctx"),
        F.array_union(F.array_union(
            F.regexp_extract_all("_raw", F.lit(SQL_WRITE_RE), 1),
            F.regexp_extract_all("_norm", F.lit(SQL_WRITE_RE), 1)),
            F.transform(F.regexp_extract_all("_code", F.lit(PY_WRITE_RE), 1),
                        lambda t: F.replace(t, F.lit("`"), F.lit("")))).alias("_targets"))
    prefix = F.concat(F.lower(F.col("_sb")), F.lit("."))
    # Without a sandbox name no target is inside it.
    outside = F.filter("_targets", lambda t: t.contains(".") & ~F.coalesce(F.lower(t).startswith(prefix), F.lit(False)))
    # Where a hit first stands: in the normalized text, else in the raw one.
    at = lambda x: F.coalesce(F.nullif(F.position(x, F.col("_norm")), F.lit(0)), F.position(x, F.col("_raw")))
    hits = F.concat(
        F.transform("_ctx", lambda m: F.struct(F.lit("context").alias("kind"), m.alias("detail"), at(m).alias("at"))),
        F.transform(outside, lambda t: F.struct(F.lit("write").alias("kind"), t.alias("detail"), at(t).alias("at"))))
    return found.select(F.col(id_col), F.explode(hits).alias("h")).select(id_col, "h.kind", "h.detail", "h.at")


def sandbox_verdicts(df: DataFrame, id_col: str, code_col: str, schema_col: str) -> DataFrame:
    """One row per step: ``allowed`` and its first violation (context
    changes before writes, then text order), or NULL when allowed."""
    hits = sandbox_violations(df, id_col, code_col, schema_col)
    first = hits.groupBy(id_col).agg(
        F.min(F.struct(F.when(F.col("kind") == "context", 0).otherwise(1).alias("_o"),
                       "at", "kind", "detail")).alias("_f"))
    return (df.select(id_col).join(first, id_col, "left")
              .select(id_col, F.col("_f").isNull().alias("allowed"),
                      F.when(F.col("_f").isNotNull(),
                             F.concat(F.col("_f.kind"), F.lit(": "), F.col("_f.detail")))
                       .alias("violation")))


# ---------------------------------------------------------------- T6

def split_sql(code) -> Column:
    """Statements of a SQL script split at ``;`` outside single quotes
    (``''`` escapes a quote, an open quote runs to the end), trimmed, empty
    ones dropped. Linear in the script, whatever its statements' size: the
    pieces between quotes alternate between outside and inside."""
    # U+0000 stands for a separator; the code's own are written as U+0001 U+0002.
    own = F.replace(F.replace(_c(code), F.lit("\x01"), F.lit("\x01\x03")), F.lit("\x00"), F.lit("\x01\x02"))
    pieces = F.transform(F.split(own, "'", -1), lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(";"), F.lit("\x00"))).otherwise(p))
    back = lambda p: F.replace(F.replace(p, F.lit("\x01\x02"), F.lit("\x00")), F.lit("\x01\x03"), F.lit("\x01"))
    parts = F.transform(F.split(F.array_join(pieces, "'"), "\x00", -1), lambda p: _strip(back(p)))
    return F.filter(parts, lambda p: p != "")


# ---------------------------------------------------------------- T7

def parse_responses(df: DataFrame, text_col: str = "text",
                    step_col: str = "step_index") -> DataFrame:
    """Parse stored translation responses: the first json header block, then
    the first sql/python/pyspark block after it. Adds language, code,
    inputs, outputs and ``error`` (NULL when the response parsed).

    Regex results are computed once per row in a first projection, which the
    optimizer keeps separate because they are referenced several times.
    """
    t = F.col(text_col)
    cols = df.columns
    base = df.select(
        "*",
        t.rlike(r"(?s)```json\s*\n.*?```").alias("_has_header"),
        F.regexp_extract(t, JSON_BLOCK_RE, 1).alias("_header"),
        F.regexp_extract(t, JSON_BLOCK_RE, 2).alias("_rest"))
    parsed = base.select(
        "*",
        (F.try_parse_json("_header").isNotNull() & F.trim("_header").startswith("{")).alias("_valid"),
        F.from_json("_header", HEADER_SCHEMA).alias("_h"),
        F.regexp_extract("_rest", CODE_BLOCK_RE, 1).alias("_fence"),
        F.regexp_extract("_rest", CODE_BLOCK_RE, 2).alias("_code"))
    lang = F.coalesce(F.col("_h.language"), F.lit(""))
    error = (F.when(~F.col("_has_header"), F.lit("missing ```json header block"))
              .when(~F.col("_valid"), F.lit("bad json header"))
              .when(F.col("_fence") == "", F.lit("missing code block after header"))
              .when(~lang.isin("sql", "pyspark"),
                    F.concat(F.lit("language must be sql|pyspark, got '"), lang, F.lit("'"))))
    checked = parsed.select("*", error.alias("error"))
    ok = F.col("error").isNull()
    return checked.select(
        *[F.col(f"`{c}`") for c in cols],
        F.when(ok, lang).alias("language"),
        F.when(ok, _strip(F.col("_code"))).alias("code"),
        F.when(ok, F.coalesce(F.col("_h.inputs"), F.array().cast("array<string>"))).alias("inputs"),
        F.when(ok, F.coalesce(F.col("_h.outputs"), F.array().cast("array<string>"))).alias("outputs"),
        "error")


# ---------------------------------------------------------------- reading a corpus

def read_corpus(spark, pattern: str, id_from_name: bool = True) -> DataFrame:
    """Read script files whole: ``program_id`` (file name without suffix),
    ``path`` (scheme-less) and ``source``. One row per file."""
    df = spark.read.text(pattern, wholetext=True).select(
        F.regexp_replace(F.input_file_name(), r"^file:(//)?", "").alias("path"),
        F.col("value").alias("source"))
    if id_from_name:
        df = df.withColumn("program_id", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))
    return df
