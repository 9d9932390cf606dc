"""SAS scalar semantics as Spark column expressions.

SAS dates count days from 1960-01-01; SAS missing values sort lowest and
compare as less than any value; character comparison ignores trailing blanks;
numeric/character conversion is explicit here (Spark 4 runs in ANSI mode).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The SAS date epoch; the characters Python's str.rstrip()
# removes (every code point whose str.isspace() is true), in code point order;
# the texts that mean "missing" once trimmed.
SAS_EPOCH = _dt.date(1960, 1, 1)
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
              "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")
MISSING_TEXT = ("", ".")
# A number as text; no type suffix, no names of infinities.
NUMBER_RE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Day numbers that still give a date between 0001-01-01 and 9999-12-31.
MIN_SAS_DAY = (_dt.date(1, 1, 1) - SAS_EPOCH).days
MAX_SAS_DAY = (_dt.date(9999, 12, 31) - SAS_EPOCH).days


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _number(c: Column) -> Column:
    """A number or the text of one as a double; anything else is missing."""
    text = F.btrim(c.cast("string"), F.lit(WHITESPACE))
    return F.when(text.rlike(NUMBER_RE), text.try_cast("double"))


def _value(c) -> Column:
    """A value to compare: NaN is missing. (The type test folds away.)"""
    c = _c(c)
    nan = F.typeof(c).isin("double", "float") & (c.cast("string") == "NaN")
    return F.when(F.coalesce(nan, F.lit(False)), F.lit(None)).otherwise(c)


def sas_date_to_iso(c) -> Column:
    """SAS day number (number or numeric text) -> ``yyyy-MM-dd`` text.

    NULL, NaN, non-numeric text and out-of-range days give NULL; a fraction
    is truncated toward zero.
    """
    num = _number(_c(c))
    days = (F.when(F.isnan(num) | (num <= MIN_SAS_DAY - 1) | (num >= MAX_SAS_DAY + 1), None)
             .otherwise(num.cast("long").cast("int")))
    return F.date_format(F.date_add(F.lit(SAS_EPOCH), days), "yyyy-MM-dd")


def sas_day_from_date(c) -> Column:
    """Date (or timestamp) -> SAS day number (days since 1960-01-01)."""
    return F.datediff(_c(c).cast("date"), F.lit(SAS_EPOCH))


def normalize_value(c, dtype: T.DataType) -> Column:
    """One cell as SAS would land it: NaN -> NULL; text right-trimmed of all
    whitespace, then ``""`` or ``"."`` -> NULL; other types unchanged."""
    c = _c(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), F.lit(None).cast(dtype)).otherwise(c)
    if isinstance(dtype, T.StringType):
        s = F.rtrim(c, F.lit(WHITESPACE))
        return F.when(s.isin(*MISSING_TEXT), F.lit(None).cast("string")).otherwise(s)
    return c


# --- missing-aware comparisons: missing is lower than every value ----------

def sas_lt(a, b) -> Column:
    a, b = _value(a), _value(b)
    return (F.when(b.isNull(), F.lit(False))
             .when(a.isNull(), F.lit(True))
             .otherwise(a < b))


def sas_le(a, b) -> Column:
    a, b = _value(a), _value(b)
    return (F.when(a.isNull(), F.lit(True))
             .when(b.isNull(), F.lit(False))
             .otherwise(a <= b))


def sas_gt(a, b) -> Column:
    return sas_lt(b, a)


def sas_ge(a, b) -> Column:
    return sas_le(b, a)


def sas_eq(a, b) -> Column:
    return _value(a).eqNullSafe(_value(b))


def sas_ne(a, b) -> Column:
    return ~sas_eq(a, b)


def sas_text_eq(a, b) -> Column:
    """Character equality ignoring trailing blanks; missing text is blank."""
    return F.rtrim(F.coalesce(_c(a), F.lit(""))) == F.rtrim(F.coalesce(_c(b), F.lit("")))


# --- explicit conversions --------------------------------------------------

def to_sas_num(c) -> Column:
    """Character -> numeric; invalid text becomes missing (NULL)."""
    return _number(_c(c))


def to_sas_char(c) -> Column:
    """Numeric -> character; whole numbers print without a fraction."""
    c = _c(c)
    d = c.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < F.lit(1e15))
    return F.when(whole, d.cast("long").cast("string")).otherwise(c.cast("string"))


# --- ordering ---------------------------------------------------------------

def sas_sort_order(df: DataFrame, spec) -> list[Column]:
    """Sort expressions with SAS missing-lowest order.

    ``spec`` is a list of column names or ``(name, "asc"|"desc")`` pairs.
    NaN counts as missing (Spark would otherwise sort NaN highest).
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for item in spec:
        name, how = (item, "asc") if isinstance(item, str) else item
        c = F.col(name)
        if isinstance(types.get(name), (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None).cast(types[name])).otherwise(c)
        out.append(c.asc_nulls_first() if how == "asc" else c.desc_nulls_last())
    return out
