"""Aggregates with streaming-SQL result types."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import BITS, wrap


def _filtered(x: Column, where: Column | None) -> Column:
    return x if where is None else F.when(where, x)


def sum_int(x: Column, to: str = "bigint", *, where: Column | None = None, distinct: bool = False) -> Column:
    """SUM in the input's type, wrapping at its width: modulo arithmetic doesn't depend on the order."""
    x = _filtered(x, where).cast("decimal(38,0)" if to == "bigint" else "bigint")
    return wrap(F.sum_distinct(x) if distinct else F.sum(x), to)


def avg_int(x: Column, to: str = "bigint", *, where: Column | None = None) -> Column:
    """AVG of integers: sum / count, truncated toward zero."""
    assert to in BITS
    x = _filtered(x, where).cast("decimal(38,0)")
    total, n = F.sum(x), F.count(x)
    return F.when(n > 0, ((total - total % F.greatest(n, F.lit(1))) / F.greatest(n, F.lit(1))).cast(to))


def sum_float(x: Column) -> Column:
    return F.sum(x.cast("double")).cast("float")


def sum_decimal(x: Column, scale: int, *, where: Column | None = None) -> Column:
    """DECIMAL(38, scale); NULL when it overflows."""
    return F.try_sum(_filtered(x, where).cast(f"decimal(38,{scale})"))


def avg_decimal(x: Column, scale: int) -> Column:
    """DECIMAL(38, max(6, scale)); NULL when the sum overflows."""
    total, n = F.try_sum(x.cast(f"decimal(38,{scale})")), F.count(x)
    if scale <= 6:
        return F.when(n > 0, (total / F.greatest(n, F.lit(1)).cast("decimal(20,0)"))).cast("decimal(38,6)")
    return _exact_quotient(scale)(total, n)


def _exact_quotient(scale: int):
    """Spark collapses the quotient of wide decimals to scale 6; this keeps 38 digits, one value per group."""
    import decimal

    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(f"decimal(38,{scale})")
    def quotient(total: pd.Series, n: pd.Series) -> pd.Series:
        context = decimal.Context(prec=38, rounding=decimal.ROUND_HALF_UP)
        one = decimal.Decimal(1).scaleb(-scale)
        return pd.Series([None if t is None or not k else context.divide(t, decimal.Decimal(int(k))).quantize(one, rounding=decimal.ROUND_HALF_UP, context=context) for t, k in zip(total, n)], dtype=object)

    return quotient


def count(x: Column | None = None, *, where: Column | None = None, distinct: bool = False) -> Column:
    x = _filtered(F.lit(1) if x is None else x, where)
    return F.count_distinct(x) if distinct else F.count(x)


def minimum(x: Column, *, where: Column | None = None) -> Column:
    return F.min(_filtered(x, where))


def maximum(x: Column, *, where: Column | None = None) -> Column:
    return F.max(_filtered(x, where))


def first_value(x: Column) -> Column:
    return F.first(x, ignorenulls=True)


def last_value(x: Column) -> Column:
    return F.last(x, ignorenulls=True)
