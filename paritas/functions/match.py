"""Value matching (tolerant float compare), row encodings and row hashes.

Everything here returns a Column, so it runs inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types compared with a relative tolerance; everything else compares exactly.
FLOAT_TYPES = (T.DoubleType, T.FloatType, T.DecimalType)

# Absolute floor of the tolerance, so values near zero can still match.
ABS_TOL = 1e-12

# Field separator and NULL marker of the row encoding (real control characters).
FIELD_SEP = "\x1f"
NULL_MARK = "\x00"


def is_float_type(dt: T.DataType) -> bool:
    """True fractions; a decimal of scale 0 is a whole number."""
    return isinstance(dt, FLOAT_TYPES) and not is_whole(dt)


def is_whole(dt: T.DataType) -> bool:
    return isinstance(dt, T.IntegralType) or isinstance(dt, T.DecimalType) and dt.scale == 0


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which values of both sides compare without loss; two whole
    numbers never meet as floats. Text and other families stay as they are."""
    if a == b or not (isinstance(a, T.NumericType) and isinstance(b, T.NumericType)):
        return a
    if is_whole(a) and is_whole(b):
        return T.LongType() if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType) else T.DecimalType(38, 0)
    return T.DoubleType()


def number_text(c: Column, dtype: T.DataType) -> Column:
    """Text that two numbers share exactly when they are equal, for key columns
    that hold whole numbers on one side and floats on the other (as doubles,
    different whole numbers above 2**53 would merge)."""
    if is_whole(dtype):
        return c.cast("decimal(38,0)").cast("string")
    if isinstance(dtype, T.DecimalType):
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    d = c.cast("double") + F.lit(0.0)
    whole = (d == F.floor(d)) & (F.abs(d) < F.lit(9.2e18))
    return F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))


def _nested(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ArrayType, T.MapType, T.StructType))


def _ordered(c: Column, dt: T.DataType) -> Column:
    """A nested value with every map in it as its entries sorted by key text."""
    if isinstance(dt, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(
            _plain(e["key"], dt.keyType).alias("k"), _plain(e["value"], dt.valueType).alias("v")))
        return F.array_sort(entries)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _plain(x, dt.elementType))
    fields = [_plain(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(dt.fields)]
    return F.when(c.isNotNull(), F.struct(*fields))


def _plain(c: Column, dt: T.DataType) -> Column:
    return content_text(c, dt) if _nested(dt) else c.cast("string")


def content_text(c: Column, dt: T.DataType) -> Column:
    """Text of a nested value that compares by content: maps in any order are
    equal, nulls and the text "null" differ, at every depth."""
    return F.to_json(F.struct(_ordered(c, dt).alias("v")), {"ignoreNullFields": "false"})


def ten_digits(c: Column) -> list[Column]:
    """Two values that are equal for two floats exactly when their ``%.9e``
    texts are: the rounded double, and the text where parsing it back is not
    one-to-one. Amounts with at most ten digits at two decimals are their own
    rounding and are never formatted."""
    x = c.cast("double") + F.lit(0.0)
    d = F.rint(x * F.lit(100.0))
    short = (F.abs(d) < F.lit(1e10)) & ((d / F.lit(100.0)) == x)
    formatted = F.format_string("%.9e", x)
    # One branch formats, and no condition holds it alone: what a condition
    # holds may be computed for every row.
    back = F.when(short, x).otherwise(formatted.try_cast("double"))  # of a null: null
    inf = F.lit(float("inf"))
    as_text = (((F.abs(back) < F.lit(1e-290)) & (back != F.lit(0.0))) | ((F.abs(back) == inf) & (F.abs(x) != inf)))
    return [F.when(~as_text, back), F.when(as_text, formatted)]


def row_hashes(columns: list[tuple], rounded: bool) -> list[Column]:
    """Two 64-bit hashes of a row under different seeds; ``columns`` as for
    :func:`row_line`. Fixed width, no text is built for plain columns. Floats
    count by their ten digits if ``rounded``, else by their exact value (-0.0 as
    0.0). Two different rows share both with a probability of about 2**-128."""
    parts, nulls = [], []
    for name, as_float, dtype in sorted(columns, key=lambda c: c[0]):
        c = F.col(f"`{name}`")
        nulls.append(c.isNull())
        if as_float:
            parts += ten_digits(c) if rounded else [c.cast("double") + F.lit(0.0)]
        elif _nested(dtype):
            parts.append(content_text(c, dtype))
        else:
            parts.append(c)
    # A null leaves xxhash64 as it was, so which columns are null goes in as bits.
    masks = [reduce(lambda x, y: x + y, [F.when(n, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, n in enumerate(nulls[at:at + 60])])
             for at in range(0, len(nulls), 60)]
    return [F.xxhash64(F.lit(seed), *masks, *parts) for seed in (1, 0x5EED)]


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def values_match(a: Column, b: Column, rel_tol: float | None = 1e-9) -> Column:
    """Never-NULL boolean: do two cells hold the same value?

    NULL matches only NULL. With ``rel_tol`` set (float family), two finite
    values match when ``|a-b| <= max(rel_tol * max(|a|,|b|), 1e-12)``; NaN
    matches NaN and an infinity only the same infinity (through ``<=>``).
    With ``rel_tol=None`` the comparison is exact.
    """
    exact = a.eqNullSafe(b)
    if rel_tol is None:
        return exact
    da, db = a.cast("double"), b.cast("double")
    close = (_finite(da) & _finite(db)
             & (F.abs(da - db) <= F.greatest(F.greatest(F.abs(da), F.abs(db)) * F.lit(float(rel_tol)),
                                             F.lit(ABS_TOL))))
    return exact | F.coalesce(close, F.lit(False))


def float_key(c: Column) -> Column:
    """Text that is equal for two floats exactly when their ``%.9e`` texts
    (ten significant digits) are equal, without formatting most values.

    The key is the double nearest to the value rounded to ten significant
    digits, rendered by ``Double.toString``. A value that already has at most
    ten significant digits at two decimals (``rint(x*100)/100 == x`` exactly,
    e.g. amounts) is its own rounding, so it skips the formatter. Others are
    formatted with ``%.9e`` and parsed back (parsing is correctly rounded, and
    distinct ten-digit decimals are more than one ulp apart above 1e-290;
    below that, and where the rounding of a finite value overflows to
    infinity, the formatted text itself is the key). -0.0 folds into 0.0.
    """
    x = c.cast("double") + F.lit(0.0)
    d = F.rint(x * F.lit(100.0))
    short = (F.abs(d) < F.lit(1e10)) & ((d / F.lit(100.0)) == x)
    formatted = F.format_string("%.9e", x)
    back = formatted.try_cast("double")  # of a null: null
    inf = F.lit(float("inf"))
    # Where parsing back is not one-to-one the formatted text is the key:
    # below 1e-290, and finite values whose rounding overflows to infinity.
    keep_text = (((F.abs(back) < F.lit(1e-290)) & (back != F.lit(0.0)))
                 | ((F.abs(back) == inf) & (F.abs(x) != inf)))
    return F.when(short, x.cast("string")).when(keep_text, formatted).otherwise(back.cast("string"))


def comparable(c: Column, dtype: T.DataType | None) -> Column:
    """A form of ``c`` that compares by content (nested values as text)."""
    return content_text(c, dtype) if dtype is not None and _nested(dtype) else c


def _text(c: Column, dtype: T.DataType | None, as_float: bool) -> Column:
    if as_float:
        return float_key(c)
    if dtype is not None and _nested(dtype):
        return content_text(c, dtype)
    # Cheap injective renderings where a string cast would be slow.
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("string")
    # timestamp_ntz falls through to its text form: rendering a wall-clock
    # value involves no time zone (converting it to an instant would, and a
    # DST gap could then merge two values).
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


# Types whose text never contains the field separator or is empty.
_PLAIN_TYPES = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _field(c: Column, as_float: bool, dtype: T.DataType | None = None) -> Column:
    text = _text(c, dtype, as_float)
    if as_float or isinstance(dtype, _PLAIN_TYPES):
        return F.coalesce(text, F.lit(NULL_MARK))
    # Free text: a length prefix keeps the encoding injective whatever the
    # text contains. No conditional branch: the text is computed once (shared
    # subexpression) and a NULL value makes the concat NULL -> NULL marker.
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit(NULL_MARK))


def row_line(columns: list[tuple], prefix: str = "") -> Column:
    """Encode a row as text; equal rows (floats to 10 significant digits)
    encode alike, different rows differ.

    ``columns`` is ``[(name, as_float[, dtype]), ...]``, in any order (names
    are sorted here). Every field is length-prefixed (NULL has its own
    marker); float fields use :func:`float_key`. Both sides of a comparison
    must pass the same column list (see ``align``).
    """
    cols = sorted(columns, key=lambda c: c[0])
    parts = [_field(F.col(f"`{prefix}{c[0]}`"), c[1], c[2] if len(c) > 2 else None) for c in cols]
    return F.concat_ws(FIELD_SEP, *parts)


def row_hash(columns: list[tuple], prefix: str = "") -> Column:
    """32-byte SHA-256 of :func:`row_line` (binary, half the shuffle bytes of hex)."""
    return F.unhex(F.sha2(row_line(columns, prefix), 256))


def all_true(cols: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, cols) if cols else F.lit(True)
