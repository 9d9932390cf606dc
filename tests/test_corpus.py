import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paritas.operators import corpus as T

ETL = """options nodate;
libname src '/data/src';
%let since = 2023-06-30;

data work.recent;
  set src.accounts;
  where opened >= "&since."d;
run;

proc sql;
  create table work.by_branch as
  select branch, count(*) as n
  from work.recent
  group by branch;
quit;

proc summary data=work.recent nway;
  var amount;
  output out=work.totals sum=total_amount;
run;
"""

MACRO = """%macro keep_first(ds);
  proc sort data=&ds nodupkey; by key; run;
%mend;
"""


def steps_of(spark, texts):
    df = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "program_id STRING, source STRING")
    return {(r["program_id"], r["step_index"]): (r["kind"], r["code"])
            for r in T.split_steps(df).collect()}


def test_etl_script_steps(spark):
    s = steps_of(spark, [T_ETL_EXPANDED(spark)])
    assert [s[("p0", i)][0] for i in range(4)] == ["global", "data", "proc", "proc"]
    assert "create table work.by_branch" in s[("p0", 2)][1]
    assert '"2023-06-30"d' in s[("p0", 1)][1]


def T_ETL_EXPANDED(spark):
    df = spark.createDataFrame([(ETL,)], "s STRING")
    return df.select(T.expand_lets("s")).first()[0]


def test_macro_is_one_step(spark):
    s = steps_of(spark, [MACRO])
    assert list(s.values()) == [("macro", MACRO.strip())]


def test_commented_out_step_is_dropped(spark):
    df = spark.createDataFrame([("/* data old; set x; run; */\ndata new; set y; run;\n",)], "s STRING")
    stripped = df.select(T.strip_block_comments("s")).first()[0]
    assert stripped == "\ndata new; set y; run;\n"
    s = steps_of(spark, [stripped])
    assert [v[0] for v in s.values()] == ["data"] and "new" in s[("p0", 0)][1]


def test_implicit_boundary_and_multiline_proc(spark):
    s = steps_of(spark, ["data a; set b;\nproc print data=a; run;\n",
                         "proc means\n  data=work.f noprint;\n  var x;\nrun;\n",
                         "data = 5;\n"])
    assert (s[("p0", 0)][0], s[("p0", 1)][0]) == ("data", "proc")
    assert [k for k in s if k[0] == "p1"] == [("p1", 0)] and s[("p1", 0)][0] == "proc"
    assert s[("p2", 0)][0] == "global"


def test_macro_body_is_not_split_and_mend_closes(spark):
    src = "%macro m;\ndata x; set y; run;\nproc print; run;\n%mend;\ndata z; run;\n"
    s = steps_of(spark, [src])
    assert [s[("p0", i)][0] for i in range(2)] == ["macro", "data"]


def test_strip_comments_keeps_newlines(spark):
    df = spark.createDataFrame([("a /* x\ny\nz */ b /**/ c",)], "s STRING")
    assert df.select(T.strip_block_comments("s")).first()[0] == "a \n\n b  c"


def test_expand_lets_rules(spark):
    src = ("%let v = 1;\n%let vv = two;\n%LET v = 3 ;\nx = &v. + &V + &vv + &vx;\npath = '&vv.\\n$1';\n")
    df = spark.createDataFrame([(src,)], "s STRING")
    out = df.select(T.expand_lets("s")).first()[0]
    assert "%let" not in out.lower()
    assert "x = 3 + 3 + two + 3x;" in out          # last definition wins; &vx hits the prefix
    assert "path = 'two\\n$1';" in out


def test_resolve_includes_files(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "c")
    os.makedirs(os.path.join(root, "lib", "deep"))
    with open(os.path.join(root, "main.sas"), "w") as f:
        f.write("%include 'lib/m.sas';\ndata a; set b; run;\n%INCLUDE \"lib/deep/u.sas\" ;\n")
    with open(os.path.join(root, "lib", "m.sas"), "w") as f:
        f.write("%macro m; %mend;\n%include 'deep/u.sas';\n")
    with open(os.path.join(root, "lib", "deep", "u.sas"), "w") as f:
        f.write("%let u = 1;\n")
    with open(os.path.join(root, "bad.sas"), "w") as f:
        f.write("%include 'nope.sas';\n")
    files = T.read_corpus(spark, [os.path.join(root, "*.sas"), os.path.join(root, "lib", "*.sas"),
                              os.path.join(root, "lib", "deep", "*.sas")])
    progs = files.filter(F.col("program_id").isin("main", "bad"))
    got = {r["program_id"]: (r["source"], r["include_error"])
           for r in T.resolve_includes(progs, files).collect()}
    assert got["main"] == ("%macro m; %mend;\n%let u = 1;\n\n\ndata a; set b; run;\n%let u = 1;\n\n", None)
    assert got["bad"][1].startswith("include not found:")


def test_include_cycle_hits_depth_limit(spark):
    files = spark.createDataFrame([("/c/a.sas", "%include 'b.sas';"), ("/c/b.sas", "%include 'a.sas';")],
                                  "path STRING, source STRING")
    progs = files.filter("path = '/c/a.sas'").withColumn("program_id", F.lit("a"))
    r = T.resolve_includes(progs, files, max_depth=4).first()
    assert r["include_error"] == "%include nesting exceeds max depth"


def violations(spark, code, schema="sandbox_p1"):
    df = spark.createDataFrame([("s", code, schema)], "id STRING, code STRING, sb STRING")
    return [(r["kind"], r["detail"]) for r in T.sandbox_violations(df, "id", "code", "sb").collect()]


@pytest.mark.parametrize("code", [
    "CREATE TABLE sandbox_p1.out AS SELECT 1", "CREATE TABLE out AS SELECT 1",
    "SELECT * FROM ground_truth.gt", "CREATE TABLE IF NOT EXISTS sandbox_p1.ok AS SELECT 1",
    'df.write.insertInto("sandbox_p1.ok")', "UPDATE staging SET x = 1",
    "MERGE INTO sandbox_p1.t USING s ON t.k=s.k WHEN MATCHED THEN UPDATE SET x = 1"])
def test_sandbox_allows(spark, code):
    assert violations(spark, code) == []


@pytest.mark.parametrize("code", [
    "DROP TABLE ground_truth.gt", 'df.write.saveAsTable("staging_inputs.x")',
    "CREATE TABLE `ground_truth`.`gt` AS SELECT 1", "CREATE TABLE IF NOT EXISTS ground_truth.evil AS SELECT 1",
    'df.write.insertInto("staging_inputs.x")', 'df.writeTo("ground_truth.gt").append()',
    "UPDATE ground_truth.gt SET x = 1", "DELETE FROM ground_truth.gt WHERE x = 1",
    "ALTER TABLE ground_truth.gt ADD COLUMN y INT", "REPLACE TABLE ground_truth.gt AS SELECT 1",
    "USE staging_inputs", "DROP SCHEMA ground_truth CASCADE", "CREATE SCHEMA evil",
    'spark.catalog.setCurrentDatabase("staging_inputs")', "INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT 1",
    'df.write.saveAsTable(f"ground_truth.x")', "CREATE TABLE -- note\nground_truth.x AS SELECT 1",
    "DROP TABLE ground_truth . gt", "SELECT 'a--b' AS x; DROP TABLE ground_truth.gt;",
    "CREATE TABLE /* note */ ground_truth.x AS SELECT 1"])
def test_sandbox_blocks(spark, code):
    assert violations(spark, code)


def scanner_split(code):
    """Character scanner used as the brute-force spec of statement splitting."""
    out, cur, quoted, i = [], "", False, 0
    while i < len(code):
        c = code[i]
        if quoted and code.startswith("''", i):
            cur, i = cur + "''", i + 2
            continue
        if c == "'":
            quoted = not quoted
        if c == ";" and not quoted:
            out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    out.append(cur)
    return [s.strip() for s in out if s.strip()]


def test_split_sql_cases(spark):
    df = spark.createDataFrame([("SELECT 'a;b' AS x; CREATE TABLE t AS SELECT 1;",),
                                ("SELECT 'O''Brien; x' AS n; SELECT 2;",), ("a; 'open; b",), (" ; ;",)], "c STRING")
    got = [r[0] for r in df.select(T.split_sql("c")).collect()]
    assert got == [["SELECT 'a;b' AS x", "CREATE TABLE t AS SELECT 1"],
                   ["SELECT 'O''Brien; x' AS n", "SELECT 2"], ["a", "'open; b"], []]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab '; \n", max_size=30), min_size=1, max_size=8))
def test_split_sql_property(spark, codes):
    df = spark.createDataFrame([(c,) for c in codes], "c STRING")
    got = [r[0] for r in df.select(T.split_sql("c")).collect()]
    assert got == [scanner_split(c) for c in codes]


GOOD = ('```json\n{"language": "sql", "inputs": ["in.a"], "outputs": ["sb.f"]}\n```\n'
        "```sql\nCREATE TABLE sb.f AS SELECT * FROM in.a;\n```")


def test_parse_responses(spark):
    rows = [(0, GOOD),
            (1, '```json\n{"language": "pyspark", "inputs": [], "outputs": ["sb.s"]}\n```\n```python\nx = 1\n```'),
            (2, "```sql\nSELECT 1;\n```"),
            (3, "```json\n{bad\n```\n```sql\nSELECT 1;\n```"),
            (4, '```json\n{"language": "sql"}\n```\nno code'),
            (5, '```json\n{"language": "scala"}\n```\n```sql\nSELECT 1\n```'),
            (6, '```sql\nSELECT 0\n```\n```json\n{"language": "sql"}\n```\n```python\nlate\n```')]
    df = spark.createDataFrame(rows, "step_index INT, text STRING")
    got = {r["step_index"]: r for r in T.parse_responses(df).collect()}
    assert got[0]["language"] == "sql" and got[0]["outputs"] == ["sb.f"] and got[0]["error"] is None
    assert got[0]["code"].startswith("CREATE TABLE sb.f")
    assert got[1]["language"] == "pyspark" and got[1]["code"] == "x = 1"
    assert got[2]["error"] == "missing ```json header block"
    assert got[3]["error"] == "bad json header"
    assert got[4]["error"] == "missing code block after header"
    assert got[5]["error"] == "language must be sql|pyspark, got 'scala'"
    assert got[6]["code"] == "late"               # first code block after the header


@pytest.mark.parametrize("chain,ok", [(3, True), (4, False)])
def test_include_depth_boundary(spark, chain, ok):
    # program -> f1 -> ... -> f<chain>; with max_depth 4 a chain of 3 files is fine.
    rows = [(f"/c/f{i}.sas", f"%include 'f{i + 1}.sas';" if i < chain else "x = 1;")
            for i in range(1, chain + 1)]
    files = spark.createDataFrame(rows, "path STRING, source STRING")
    progs = spark.createDataFrame([("p", "/c/p.sas", "%include 'f1.sas';")],
                                  "program_id STRING, path STRING, source STRING")
    r = T.resolve_includes(progs, files, max_depth=4).first()
    assert (r["include_error"] is None) == ok
    if ok:
        assert r["source"] == "x = 1;"


def test_read_corpus_ids_and_paths(spark, tmpdir_path):
    os.makedirs(os.path.join(tmpdir_path, "s"))
    for name, text in (("etl.sas", "data a; run;\n"), ("x.y.sas", "proc print; run;\n")):
        with open(os.path.join(tmpdir_path, "s", name), "w") as f:
            f.write(text)
    got = {r["program_id"]: (r["path"], r["source"]) for r in
           T.read_corpus(spark, os.path.join(tmpdir_path, "s", "*.sas")).collect()}
    assert set(got) == {"etl", "x.y"}
    assert got["etl"][0] == os.path.join(tmpdir_path, "s", "etl.sas") and got["etl"][1] == "data a; run;\n"


def test_sandbox_verdicts(spark):
    df = spark.createDataFrame([("a", "CREATE TABLE sb.x AS SELECT 1", "sb"),
                                ("b", "DROP TABLE gt.t; USE other", "sb")], "id STRING, code STRING, sb STRING")
    got = {r["id"]: (r["allowed"], r["violation"]) for r in T.sandbox_verdicts(df, "id", "code", "sb").collect()}
    assert got["a"] == (True, None)
    assert got["b"][0] is False and got["b"][1].startswith("context: USE")


def statements(spark, code):
    return spark.createDataFrame([(code,)], "c string").select(T.split_sql("c").alias("s")).first()["s"]


def plain_statements(code):
    out, now, quoted = [], "", False
    for ch in code:
        quoted ^= ch == "'"
        if ch == ";" and not quoted:
            out.append(now)
            now = ""
        else:
            now += ch
    return [x.strip() for x in [*out, now] if x.strip()]


def test_sql_split_is_linear_and_exact(spark):
    big = "SELECT " + "x + " * 250_000 + "1; SELECT 'a;" + "b" * 200_000 + "'';c'; SELECT 'open; end"
    assert statements(spark, big) == plain_statements(big)
    for code in ("", ";;", "a;b", "'a;''b;';c", "x\x00y;\x01z;\x01\x02;'\x00;'", " s ; '", "a''b;c"):
        assert statements(spark, code) == plain_statements(code), code


def test_write_scan_knows_unicode_and_needs_a_sandbox(spark):
    df = spark.createDataFrame([("a", "sb", "CREATE TABLE donn\u00e9es.x AS SELECT 1"), ("b", "sb", "DROP TABLE\u00a0z.t"),
                                ("c", None, "INSERT INTO sb.t SELECT 1"), ("d", "sb", "DROP TABLE z.t; DROP TABLE a.t"),
                                ("e", "sb", "DROP TABLE z.t; USE a"), ("f", "sb", "INSERT INTO SB.t SELECT 1")], "id string, sb string, code string")
    got = {r["id"]: (r["allowed"], r["violation"]) for r in T.sandbox_verdicts(df, "id", "code", "sb").collect()}
    assert got == {"a": (False, "write: donn\u00e9es.x"), "b": (False, "write: z.t"), "c": (False, "write: sb.t"), "d": (False, "write: z.t"),
                   "e": (False, "context: USE a"), "f": (True, None)}


def test_includes_with_dots(spark):
    progs = spark.createDataFrame([("p", "/c/progs/p.sas", "%include '../common/u.sas';\n%include './u2.sas';\n%include 'x/../u2.sas';")],
                                  "program_id string, path string, source string")
    files = spark.createDataFrame([("/c/common/u.sas", "U"), ("/c/progs/./u2.sas", "V")], "path string, source string")
    r = T.resolve_includes(progs, files).first()
    assert r["include_error"] is None and r["source"] == "U\nV\nV"


def test_unicode_names_and_blanks_in_scripts(spark):
    src = "%let gr\u00f6\u00dfe = 5;\n\u00a0data a; x = &gr\u00f6\u00dfe;\nrun;"
    df = spark.createDataFrame([("p", src)], "program_id string, source string")
    assert "x = 5" in df.select(T.expand_lets("source").alias("s")).first()["s"]
    steps = T.split_steps(df.select("program_id", T.expand_lets("source").alias("source"))).collect()
    assert [r["kind"] for r in steps] == ["data"]
    plan = T.split_steps(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def _steps_line_by_line(text):
    """The same rules as one walk over the lines."""
    import re
    steps, kind, macro, cut = [], "global", False, True
    for line in re.split("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", text):
        m = re.match(r"\s*(data\b(?!\s*=)|proc\s+\w+|%macro\b)", line, re.I)
        starts = bool(m) and not macro
        if starts:
            kind = "macro" if m[1][0] == "%" else m[1][:4].lower()
        if starts or cut:
            steps.append([kind, []])
        steps[-1][1].append(line)
        mend = bool(re.match(r"\s*%mend\b.*;", line, re.I))
        cut = (kind == "macro" and mend) or (kind in ("data", "proc") and bool(re.match(r"\s*(run|quit)\s*;", line, re.I)))
        macro = (macro or (bool(m) and m[1][0] == "%")) and not mend
        if cut:
            kind = "global"
    return [(k, c) for k, c in ((k, "\n".join(x).strip()) for k, x in steps) if c]


def test_steps_equal_a_walk_over_the_lines(spark):
    import random
    rnd = random.Random(6)
    parts = ["data a;", "DATA = 5;", "proc print;", " Proc  sql ;", "%macro m;", "%macro inner(x);", "%mend;", "%mend m ;", "run;", "quit ;",
             "", "  ", "set b;", "x = 'run;'; run;", "%mend", "/* data */", "odd \x00\x03\x06a", "\x02run;", "\x1cdata z;", " run;"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["\n", "\n", "\r\n", "\x0b", " "]) for _ in range(rnd.randrange(25))) for _ in range(300)]
    texts += ["", "\n\n", "run;", "%mend;", "data a;\n%macro m;\ndata b;\nrun;\n%mend;\nrun;\nx", "\x06\x06g\x05"]
    got = steps_of(spark, texts)
    for i, t in enumerate(texts):
        want = _steps_line_by_line(t)
        assert [got[f"p{i}", j] for j in range(len(want))] == want and (f"p{i}", len(want)) not in got


def test_a_script_of_many_steps_is_split_in_linear_time(spark):
    import time
    text = "".join(f"data s{i};\n  set b;\nrun;\nx = {i};\n" for i in range(30_000))
    df = spark.createDataFrame([("p", text)], "program_id string, source string")
    t = time.perf_counter()
    counts = {r["kind"]: r["count"] for r in T.split_steps(df).groupBy("kind").count().collect()}
    assert counts == {"data": 30_000, "global": 30_000} and time.perf_counter() - t < 30


def _lets_one_by_one(text):
    """The rule as it is said: each definition rewrites the whole text."""
    import re
    line = re.compile(r"^\s*%let\s+(\w+)\s*=\s*([^;]*);\s*$", re.I | re.M)
    found = {}
    for name, value in line.findall(text):
        found[name] = value.strip()
    out = line.sub("", text)
    for name in sorted(found, key=lambda n: -len(n)):
        out = re.sub(rf"&{name}\.?", lambda m: found[name], out, flags=re.I | re.A)
    return out


def test_lets_equal_one_definition_after_the_other(spark):
    import random
    rnd = random.Random(12)
    names = ["a", "b", "ab", "AB", "abc", "x1", "lib", "xab", "ba"]
    bits = ["&a", "&ab.", "&AB", "&abc..", "&lib.x", "&x1", "&&a", "&a&b", "&", "&.", "plain", " ", ".", "$1\\", "é", "&xab", "&none", "ab", "c"]
    texts = []
    for _ in range(400):
        lines = []
        for _ in range(rnd.randrange(9)):
            if rnd.random() < 0.5:
                value = "".join(rnd.choice(bits[:5] + ["v", "w ", "$2", "", "5"] * 3) for _ in range(rnd.randrange(3)))
                lines.append(f"%let {rnd.choice(names)} = {value};")
            else:
                lines.append("".join(rnd.choice(bits) for _ in range(rnd.randrange(7))))
        texts.append("\n".join(lines))
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, s STRING")
    got = {r["i"]: r["o"] for r in df.select("i", T.expand_lets("s").alias("o")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _lets_one_by_one(t), t


def test_many_definitions_in_one_script(spark):
    import time
    src = "".join(f"%let name{i} = value {i};\n" for i in range(1500)) + "".join(f"x = &name{i}. + &NAME{i};\n" for i in range(1500))
    df = spark.createDataFrame([(src,)], "s STRING")
    t = time.perf_counter()
    out = df.select(T.expand_lets("s")).first()[0].strip().split("\n")
    assert out == [f"x = value {i} + value {i};" for i in range(1500)] and time.perf_counter() - t < 20
