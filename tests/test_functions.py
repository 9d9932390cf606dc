import math

import pytest
from pyspark.sql import functions as F

from paritas.functions import match as M
from paritas.functions import sas as S


def one(spark, expr, schema=None):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def vm(spark, a, b, tol=1e-9, t="double"):
    df = spark.createDataFrame([(a, b)], f"a {t}, b {t}")
    return df.select(M.values_match(F.col("a"), F.col("b"), tol).alias("m")).first()["m"]


def test_values_match_nulls_and_exact(spark):
    assert vm(spark, None, None, None, "string")
    assert not vm(spark, None, "0", None, "string")
    assert vm(spark, "abc", "abc", None, "string")
    assert not vm(spark, "abc", "abd", None, "string")
    assert vm(spark, 7, 7, None, "int")


def test_values_match_relative_tolerance(spark):
    assert vm(spark, 1000000.0, 1000000.0000001)
    assert not vm(spark, 1000000.0, 1000000.01)
    assert vm(spark, float("nan"), float("nan"))
    assert vm(spark, 0.0, 1e-13)                    # absolute floor near zero
    assert not vm(spark, float("nan"), 5.0)
    assert not vm(spark, float("inf"), 5.0)
    assert not vm(spark, float("inf"), float("-inf"))
    assert vm(spark, float("inf"), float("inf"))
    assert not vm(spark, None, 1.0)


def test_row_line_is_injective_and_order_free(spark):
    df = spark.createDataFrame([(1, "a", 2.5, None)], "x INT, y STRING, z DOUBLE, w STRING")
    cols = [("x", False), ("y", False), ("z", True), ("w", False)]
    line = df.select(M.row_line(cols).alias("l")).first()["l"]
    again = df.select("w", "z", "y", "x").select(M.row_line(list(reversed(cols))).alias("l")).first()["l"]
    assert line == again
    assert "\x1f2.5" in line and "1:a" in line and M.NULL_MARK in line


@pytest.mark.parametrize("v,iso", [(0, "1960-01-01"), (24107, "2026-01-01"), (-1, "1959-12-31"),
                                   (0.9, "1960-01-01"), (-0.9, "1960-01-01"), (1.5, "1960-01-02"),
                                   (None, None), (float("nan"), None), (float("inf"), None),
                                   (1e12, None), (-1e12, None)])
def test_sas_date_to_iso(spark, v, iso):
    df = spark.createDataFrame([(None if v is None else float(v),)], "d DOUBLE")
    assert df.select(S.sas_date_to_iso("d").alias("v")).first()["v"] == iso


def test_sas_date_text_input(spark):
    df = spark.createDataFrame([("24107",), (" 12 ",), ("abc",), ("",)], "t STRING")
    got = [r["v"] for r in df.select(S.sas_date_to_iso("t").alias("v")).collect()]
    assert got == ["2026-01-01", "1960-01-13", None, None]


def test_sas_day_round_trip(spark):
    df = spark.createDataFrame([("2026-01-01",)], "d STRING")
    assert df.select(S.sas_day_from_date(F.to_date("d")).alias("v")).first()["v"] == 24107


def test_normalize_value(spark):
    df = spark.createDataFrame([(float("nan"), "."), (1.5, "   "), (2.0, "abc \t\n "),
                                (None, " ."), (3.0, "x")], "d DOUBLE, s STRING")
    out = df.select(S.normalize_value("d", df.schema["d"].dataType).alias("d"),
                    S.normalize_value("s", df.schema["s"].dataType).alias("s")).collect()
    assert [r["d"] for r in out] == [None, 1.5, 2.0, None, 3.0]
    assert [r["s"] for r in out] == [None, None, "abc", " .", "x"]


def test_normalize_other_types_unchanged(spark):
    df = spark.createDataFrame([(42,)], "i INT")
    assert df.select(S.normalize_value("i", df.schema["i"].dataType)).first()[0] == 42


def test_missing_lowest_comparisons(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (None, None), (1.0, 2.0), (2.0, 2.0)],
                               "a DOUBLE, b DOUBLE")
    rows = df.select(S.sas_lt("a", "b").alias("lt"), S.sas_le("a", "b").alias("le"),
                     S.sas_gt("a", "b").alias("gt"), S.sas_ge("a", "b").alias("ge"),
                     S.sas_eq("a", "b").alias("eq"), S.sas_ne("a", "b").alias("ne")).collect()
    assert [tuple(r) for r in rows] == [
        (True, True, False, False, False, True),
        (False, False, True, True, False, True),
        (False, True, False, True, True, False),
        (True, True, False, False, False, True),
        (False, True, False, True, True, False)]


def test_text_equality_ignores_trailing_blanks(spark):
    df = spark.createDataFrame([("ab  ", "ab"), ("ab", "ab\t"), (None, "  "), (" ab", "ab")],
                               "a STRING, b STRING")
    assert [r[0] for r in df.select(S.sas_text_eq("a", "b")).collect()] == [True, False, True, False]


def test_explicit_conversions(spark):
    df = spark.createDataFrame([(" 12.5 ", 3.0), ("x", 2.25), (None, None)], "t STRING, n DOUBLE")
    rows = df.select(S.to_sas_num("t").alias("n"), S.to_sas_char("n").alias("c")).collect()
    assert [r["n"] for r in rows] == [12.5, None, None]
    assert [r["c"] for r in rows] == ["3", "2.25", None]


def test_sas_sort_order_missing_first(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, float("nan")), (4, 1.0)], "k INT, v DOUBLE")
    asc = [r["k"] for r in df.orderBy(*S.sas_sort_order(df, ["v", "k"])).collect()]
    desc = [r["k"] for r in df.orderBy(*S.sas_sort_order(df, [("v", "desc"), "k"])).collect()]
    assert asc == [2, 3, 4, 1]
    assert desc == [1, 4, 2, 3]


def test_float_key_matches_ten_digit_classes(spark):
    vals = [0.1, 0.29, 1e7, 12345678.91, 1234567891.0, 123456789012.0, 0.1 + 0.2, 1 / 3, -0.0, 0.0,
            float("nan"), float("inf"), float("-inf"), 1e-300, 5e-324, 2.675, 1.0000000005,
            999999999.95, 9999999999.5, 1e22, 123.456789012345, 123.45678901, 123.4567890149,
            -5.55, 1.0000000000000002, 99999999.99, 99999999.990000001,
            -1.7976931345e+308, 1.7976931348623157e+308, 1.79769313e+308]
    df = spark.createDataFrame([(v,) for v in vals], "v DOUBLE")
    rows = df.select(F.format_string("%.9e", F.col("v") + F.lit(0.0)).alias("f"),
                     M.float_key(F.col("v")).alias("k")).collect()
    by_f, by_k = {}, {}
    for r in rows:
        by_f.setdefault(r["f"], set()).add(r["k"])
        by_k.setdefault(r["k"], set()).add(r["f"])
    assert all(len(v) == 1 for v in by_f.values()) and all(len(v) == 1 for v in by_k.values())


def test_ntz_encoding_is_zone_free(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 0, 5),), (dt.datetime(2024, 3, 10, 3, 30),)],
                               "t TIMESTAMP_NTZ")
    line = lambda: [r[0] for r in df.select(M.row_line([("t", False, df.schema["t"].dataType)])).collect()]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        a = line()
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        b = line()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert a == b and len(set(a)) == 2


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


def _near_ties(seeds):
    # Values whose 11th significant digit is a 5 (or just around it), where
    # rounding to ten digits is decided.
    out = []
    for m, e in seeds:
        base = float(f"{m}5e{e}")
        out += [base, base * (1 + 1e-16), base * (1 - 1e-16), float(f"{m}e{e}"), float(f"{m}49999e{e}")]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(allow_nan=True, allow_infinity=True, width=64), min_size=1, max_size=40),
       st.lists(st.tuples(st.integers(10 ** 9, 10 ** 10 - 1), st.integers(-40, 40)), max_size=8))
def test_float_key_partition_equals_format_partition(spark, values, seeds):
    vals = values + _near_ties(seeds)
    df = spark.createDataFrame([(v,) for v in vals], "v DOUBLE")
    rows = df.select(F.format_string("%.9e", F.col("v") + F.lit(0.0)).alias("f"),
                     M.float_key(F.col("v")).alias("k")).collect()
    f2k, k2f = {}, {}
    for r in rows:
        f2k.setdefault(r["f"], set()).add(r["k"])
        k2f.setdefault(r["k"], set()).add(r["f"])
    assert all(len(s) == 1 for s in f2k.values()), f2k
    assert all(len(s) == 1 for s in k2f.values()), k2f


def test_numbers_in_text_have_no_suffix(spark):
    from paritas.functions import sas as S
    texts = ["12d", "12f", "1D", "inf", "NaN", " 12 ", "1e2", ".5", "-3.", "1_0", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(S.to_sas_num("t")).collect()] == [None] * 5 + [12.0, 100.0, 0.5, -3.0, None, None]
    assert [r[0] for r in df.select(S.sas_date_to_iso("t")).collect()][:6] == [None] * 5 + ["1960-01-13"]


def test_nan_is_missing_in_comparisons(spark):
    from paritas.functions import sas as S
    from paritas.operators.sas import where_sas
    nan = float("nan")
    df = spark.createDataFrame([(nan, 5.0), (5.0, nan), (nan, None), (nan, nan)], "a double, b double")
    got = [tuple(r) for r in df.select(S.sas_lt("a", "b"), S.sas_ge("a", "b"), S.sas_eq("a", "b"), S.sas_ne("a", "b")).collect()]
    assert got == [(True, False, False, True), (False, True, False, True), (False, True, True, False), (False, True, True, False)]
    assert [where_sas(df, "a", op, 4.0).count() for op in (">", "<", "=", "^=")] == [1, 3, 0, 4]
    text = spark.createDataFrame([("NaN", "x")], "a string, b string")
    assert text.select(S.sas_eq("a", "b")).first()[0] is False


def test_ten_digits_are_those_of_the_text(spark):
    """Equal exactly where the ``%.9e`` texts are, whichever way they come about."""
    inf = float("inf")
    values = [None, 0.0, -0.0, 1.1, 1.1 + 1e-15, 1.1 + 1e-8, 0.01, -12345678.9, 1e10, 1e10 + 0.01, 123456789.125, 1 / 3, -1 / 3, 0.33333333333,
              inf, -inf, float("nan"), 1.7976931348623157e308, 1.797693134e308, 5e-324, 1e-323, 1.23e-291, 1.2300000000001e-291, 1e-290]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(*M.ten_digits(F.col("x")), F.when(F.col("x").isNotNull(), F.format_string("%.9e", F.col("x") + F.lit(0.0)))).collect()
    parts = [(str(a), b) for a, b, _ in got]
    for i, (_, _, text) in enumerate(got):
        assert [p == parts[i] for p in parts] == [t == text for _, _, t in got]


def test_short_amounts_are_not_formatted(spark):
    """Amounts with two decimals cost a fraction of those that need the formatter."""
    import time

    def seconds(x):
        h = M.row_hashes([("a", True, None), ("b", True, None)], rounded=True)
        rows = spark.range(0, 1_500_000, 1, 2).select(x.alias("a"), (x + F.lit(1.0)).alias("b")).select(*h)
        best = []
        for _ in range(2):
            start = time.time()
            rows.write.format("noop").mode("overwrite").save()
            best.append(time.time() - start)
        return min(best)

    assert seconds(F.col("id") / F.lit(4.0)) < 0.5 * seconds(F.col("id") / F.lit(3.0))
