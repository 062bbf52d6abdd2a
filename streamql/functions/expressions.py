"""Scalar expressions with streaming-SQL value semantics, as Column builders.

All builders are safe under ANSI mode: they widen, compute and wrap instead of relying
on session settings.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer types by name: bits.
BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def wrap(x: Column, to: str) -> Column:
    """x (a long, or a decimal without fraction) in two's complement of the integer type `to`."""
    n = BITS[to]
    if n == 64:
        whole = F.pmod(x.cast("decimal(38,0)") + F.expr("9223372036854775808BD"), F.expr("18446744073709551616BD"))
        return (whole.cast("decimal(38,0)") - F.expr("9223372036854775808BD")).cast("bigint")
    half = 1 << (n - 1)
    return (F.pmod(x.cast("bigint") + F.lit(half), F.lit(1 << n)) - F.lit(half)).cast(to)


def _wide(x: Column, to: str) -> Column:
    return x.cast("decimal(38,0)") if to == "bigint" else x.cast("bigint")


def add(a, b, to="bigint"):
    return wrap(_wide(a, to) + _wide(b, to), to)


def subtract(a, b, to="bigint"):
    return wrap(_wide(a, to) - _wide(b, to), to)


def multiply(a, b, to="bigint"):
    if to == "bigint":  # low 64 bits of the product, from 32-bit halves of b
        high, low = F.shiftright(b.cast("bigint"), 32), b.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
        part = wrap(_wide(a, to) * _wide(high, to), to)
        return wrap(_wide(part, to) * F.expr("4294967296BD") + _wide(a, to) * _wide(low, to), to)
    return wrap(_wide(a, to) * _wide(b, to), to)


def divide_int(a: Column, b: Column, to: str = "bigint") -> Column:
    """Integer division truncated toward zero."""
    a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    return wrap(((a - a % b) / b).cast("decimal(38,0)"), to)


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return a % b


def divide_float(a: Column, b: Column) -> Column:
    """IEEE division: a zero divisor gives an infinity or NaN, no error."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a.isNull(), None).when((a == 0) | F.isnan(a), float("nan")).otherwise(F.signum(a) * float("inf"))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def decimal_op(x: Column, precision: int, scale: int) -> Column:
    """A decimal result at its declared type, rounded half up; NULL where it doesn't fit."""
    return x.try_cast(f"decimal({precision},{scale})")


def decimal_div(a: Column, b: Column, precision: int, scale: int) -> Column:
    """a / b of decimals: 38 significant digits rounded half up, then the declared type; NULL where it doesn't fit, a zero divisor fails."""
    return _decimal_pair(lambda x, y, context: context.divide(x, y), precision, scale)(*_decimals(a, b))


def decimal_mod(a: Column, b: Column, precision: int, scale: int) -> Column:
    """The remainder of decimals, with the sign of the dividend; a zero divisor fails."""
    return _decimal_pair(lambda x, y, context: context.remainder(x, y), precision, scale)(*_decimals(a, b))


def _decimals(a, b):
    # Untyped, so that the divisor keeps its own type.
    return a, F.when(b == 0, F.raise_error(F.lit("decimal division by zero"))).otherwise(b)


def _decimal_pair(op, precision, scale):
    """Spark cuts quotients of wide decimals to scale 6, so these are worked out by Python's decimals, in Arrow batches."""
    import decimal

    import pandas as pd

    @F.pandas_udf(f"decimal({precision},{scale})")
    def work(a: pd.Series, b: pd.Series) -> pd.Series:
        context = decimal.Context(prec=38, rounding=decimal.ROUND_HALF_UP)
        wide = decimal.Context(prec=80, rounding=decimal.ROUND_HALF_UP)
        one, most = decimal.Decimal(1).scaleb(-scale), decimal.Decimal(10) ** (precision - scale)

        def value(x, y):
            if x is None or y is None:
                return None
            out = op(x, y, context).quantize(one, rounding=decimal.ROUND_HALF_UP, context=wide)
            return out if abs(out) < most else None

        return pd.Series([value(x, y) for x, y in zip(a, b)], dtype=object)

    return work


def number_to_string(x: Column) -> Column:
    """CAST(number AS STRING): decimals and integers plain."""
    return x.cast("string")


def string_to_number(x: Column, to: str) -> Column:
    """CAST(string AS number): white space around it is ignored; text that is no number fails."""
    return F.trim(x).cast(to)


def float_to_decimal(x: Column, precision: int, scale: int) -> Column:
    """CAST(float AS DECIMAL(p, s)), half up; NULL where it doesn't fit."""
    return x.try_cast(f"decimal({precision},{scale})")


def narrow(x: Column, to: str) -> Column:
    """Integer to a narrower integer: the low bits."""
    return wrap(x, to)


def float_to_int(x: Column, to: str = "int") -> Column:
    """Toward zero; beyond the range its ends; NaN 0."""
    top, bottom = (1 << (BITS[to] - 1)) - 1, -(1 << (BITS[to] - 1))
    return F.when(F.isnan(x), F.lit(0)).when(x >= float(top), F.lit(top)).when(x <= float(bottom), F.lit(bottom)).otherwise(F.when(F.abs(x) < 2.0**63, x).cast("bigint")).cast(to)


def to_char(x: Column, n: int) -> Column:
    """CAST(... AS CHAR(n)): cut and padded."""
    return F.rpad(x.cast("string"), n, " ")


def to_varchar(x: Column, n: int) -> Column:
    return F.substring(x.cast("string"), 1, n)


def item(collection: Column, key, kind: str = "array") -> Column:
    """arr[i] (from 1) or map[k]; NULL on any miss."""
    if kind == "map":
        return F.try_element_at(collection, key if isinstance(key, Column) else F.lit(key))
    i = key if isinstance(key, Column) else F.lit(key)
    return F.when(i >= 1, F.try_element_at(collection, i))


def split_index(s: Column, separator: str, index: int) -> Column:
    """The index-th (from 0) part of s; NULL for an empty s or beyond the parts."""
    return F.when(s != "", F.get(F.split(s, "\\Q" + separator + "\\E"), F.lit(index)))


def regexp_extract(s: Column, pattern: str, group: int = 1) -> Column:
    """NULL where the pattern isn't found."""
    return F.when(F.rlike(s, F.lit(pattern)), F.regexp_extract(s, pattern, group))


def floor(x: Column) -> Column:
    """FLOOR that stays double."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def ceil(x: Column) -> Column:
    return F.when(F.abs(x) < 2.0**52, F.ceil(x).cast("double")).otherwise(x)


def extract(unit: str, ts: Column) -> Column:
    """EXTRACT as a bigint; seconds whole."""
    return F.date_part(F.lit(unit), ts).cast("bigint")


def count_char(s: Column, char: str) -> Column:
    """How often a character stands in s; 0 for NULL."""
    if not char:
        return F.lit(0).cast("bigint")
    return F.coalesce(F.length(s) - F.length(F.replace(s, F.lit(char[0]), F.lit(""))), F.lit(0)).cast("bigint")


def to_timestamp_ltz(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def proctime() -> Column:
    return F.current_timestamp()
