"""Ranking: Top-N, limit, deduplication, OVER aggregates."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamql.functions import times


def topn(df: DataFrame, partition_by: list, order_by: list[Column], n: int, *, offset: int = 0, rank_col: str | None = None) -> DataFrame:
    """Rows with row number offset + 1 .. n per partition. order_by ends with a tie breaker (arrival)."""
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    ranked = df.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") <= n) & (F.col("_rn") > offset))
    return ranked.select(*df.columns, *([F.col("_rn").cast("bigint").alias(rank_col)] if rank_col else []))


def window_topn(df: DataFrame, partition_by: list, order_by: list[Column], n: int, *, rank_col: str | None = None) -> DataFrame:
    """Top-N per key and attached window."""
    return topn(df, ["window_start", "window_end", *partition_by], order_by, n, rank_col=rank_col)


def limit(df: DataFrame, n: int, order_by: list[Column], offset: int = 0) -> DataFrame:
    """ORDER BY ... LIMIT n OFFSET offset, or by arrival: a heap per task, merged once."""
    return df.orderBy(*order_by).offset(offset).limit(n)


def dedup(df: DataFrame, keys: list, order_by: str, seq: str, keep: str = "first") -> DataFrame:
    """One row per key: first the least order_by (ties: earlier seq), or last the greatest (ties: later seq).

    An aggregate of the row by (time, seq), so a hot key is combined before the shuffle, and
    columns of any type may come along.
    """
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in df.columns if c not in keys]
    row, at = F.struct(*(df[c] for c in rest)), F.struct(df[order_by], df[seq])
    best = df.where(df[order_by].isNotNull()).groupBy(*keys).agg(pick(row, at).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def over(df: DataFrame, partition_by: list, order_by: str, functions: dict[str, Column], frame: tuple = ("range", None)) -> DataFrame:
    """Aggregates over ... up to the current row. frame: ("range", None), ("rows", n) or ("range", "INTERVAL ..." text).

    An interval frame is taken up anew for each row; over_interval does not, for aggregates that merge.
    """
    kind, size = frame
    w = Window.partitionBy(*partition_by).orderBy(order_by)
    if kind == "rows":
        w = w.rowsBetween(Window.unboundedPreceding if size is None else -size, Window.currentRow)
    elif size is None:
        w = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        return _interval_over(df, partition_by, order_by, functions, size)
    return df.withColumns({n: f.over(w) for n, f in functions.items()})


def _interval_over(df, partition_by, order_by, functions, size):
    """RANGE INTERVAL frames: microseconds as a long, so that the bound is a plain number."""
    span = times.interval_micros(df.sparkSession, size)
    w = Window.partitionBy(*partition_by).orderBy("_micros").rangeBetween(-span, Window.currentRow)
    out = df.withColumn("_micros", times.micros(df[order_by], df.schema[order_by].dataType))
    return out.withColumns({n: f.over(w) for n, f in functions.items()}).drop("_micros")


def over_interval(df: DataFrame, partition_by: list, order_by: str, partial: dict[str, tuple[Column, str]], size: str) -> DataFrame:
    """RANGE BETWEEN size PRECEDING AND CURRENT ROW in time that grows with the rows, not with rows times frame. partial: as in over_running.

    A sliding frame takes up all its rows again for each row. Here time is cut into slices as
    long as the frame. So a frame is its row's slice up to the row, and the slice before from
    as far in as the row is in its own: two running aggregates, one of them backwards. Every
    row goes to its own slice and, to be aggregated only, to the next. A key is so dealt to as
    many tasks as it has slices. Rows without a time are each other's frame.
    """
    span = times.interval_micros(df.sparkSession, size)
    if span < 1:
        return over(df, partition_by, order_by, {n: a for n, (a, _) in partial.items()}, ("range", size))
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    at = df.withColumn("_micros", times.micros(df[order_by], df.schema[order_by].dataType)).withColumn("_at", F.pmod("_micros", F.lit(span)))
    copies = F.when(F.col("_micros").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    both = at.withColumn("_next", F.explode(copies)).withColumn("_slice", F.expr(f"(_micros - _at) div {span} + _next"))
    key = Window.partitionBy(*partition_by, "_slice")
    up, down = (key.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("_at"), F.desc("_at")))
    parts = both.withColumns({f"_part_{n}": a.over(key.orderBy("_at").rowsBetween(0, 0)) for n, (a, _) in partial.items()})
    own = {n: merge[how](F.when(F.col("_next") == 0, F.col(f"_part_{n}"))).over(up) for n, (_, how) in partial.items()}
    before = {n: merge[how](F.when(F.col("_next") == 1, F.col(f"_part_{n}"))).over(down) for n, (_, how) in partial.items()}
    out = parts.withColumns({f"_own_{n}": x for n, x in own.items()}).withColumns({f"_before_{n}": x for n, x in before.items()}).where("_next = 0")

    def total(n, how):
        return _merged(F.col(f"_before_{n}"), F.col(f"_own_{n}"), how).cast(parts.schema[f"_part_{n}"].dataType).alias(n)

    return out.select(*df.columns, *(total(n, how) for n, (_, how) in partial.items()))


def _merged(a: Column, b: Column, how: str) -> Column:
    """Two parts of an aggregate; one that saw no value is null."""
    plus = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(plus[how](a, b))


def over_running(df: DataFrame, partition_by: list, order_by: str, partial: dict[str, tuple[Column, str]], slice_size: str) -> DataFrame:
    """RANGE UNBOUNDED PRECEDING for keys that are few and hot: sums, counts, minima and maxima, spread over time slices.

    partial: output name -> (aggregate, how slices merge: sum, min or max). Rows are aggregated
    per key and slice; the slices, a small table, are summed up in order; then each slice
    finishes its own rows from what came before it. A key is so dealt to as many tasks as it has slices.
    """
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    plus = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b if b is not None else a, "min": F.least, "max": F.greatest}
    sliced = df.withColumn("_slice", F.floor(times.micros(df[order_by], df.schema[order_by].dataType) / F.lit(times.interval_micros(df.sparkSession, slice_size))))
    before = Window.partitionBy(*partition_by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy(*partition_by, "_slice").agg(*(a.alias(f"_{n}") for n, (a, _) in partial.items()))
    carried = slices.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(partition_by)), F.col("_slice").alias("_s"), *(merge[how](f"_{n}").over(before).alias(f"_before_{n}") for n, (_, how) in partial.items()))
    within = Window.partitionBy(*partition_by, "_slice").orderBy(order_by).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = sliced.withColumns({f"_own_{n}": a.over(within) for n, (a, _) in partial.items()})
    on = F.col("_slice").eqNullSafe(F.col("_s"))
    for i, c in enumerate(partition_by):
        on &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = own.join(carried, on)

    def total(n, how):
        a, b = F.col(f"_before_{n}"), F.col(f"_own_{n}")
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(plus[how](a, b)).alias(n)

    return joined.select(*df.columns, *(total(n, how) for n, (_, how) in partial.items()))
