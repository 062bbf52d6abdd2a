"""Windowing table functions and windowed aggregation over event time.

Each table function appends window_start, window_end and window_time (end - 1 ms).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = ("window_start", "window_end", "window_time")


def _flat(df: DataFrame, window: Column) -> DataFrame:
    out = df.withColumn("_w", window)
    end = F.col("_w.end")
    return out.select(*(df[c] for c in df.columns), F.col("_w.start").alias("window_start"), end.alias("window_end"), (end - F.expr("INTERVAL 1 MILLISECOND")).alias("window_time"))


def tumble(df: DataFrame, ts: str, size: str) -> DataFrame:
    return _flat(df, F.window(ts, size))


def hop(df: DataFrame, ts: str, slide: str, size: str) -> DataFrame:
    return _flat(df, F.window(ts, size, slide))


def cumulate(df: DataFrame, ts: str, step: str, max_size: str) -> DataFrame:
    """Windows that grow by step up to max_size: those of the row's max_size bucket that end after it."""
    base = df.withColumn("_b", F.window(ts, max_size))
    ends = F.expr(f"filter(sequence(_b.start + INTERVAL {step}, _b.end, INTERVAL {step}), e -> e > `{ts}`)")
    out = base.withColumn("window_end", F.explode(ends))
    return out.select(*(df[c] for c in df.columns), F.col("_b.start").alias("window_start"), "window_end", (F.col("window_end") - F.expr("INTERVAL 1 MILLISECOND")).alias("window_time"))


def window_agg(windowed: DataFrame, keys: list, aggs: list[Column]) -> DataFrame:
    """Aggregate by keys and attached window; without aggs the distinct keys per window."""
    by = [*keys, "window_start", "window_end"]
    return windowed.groupBy(*by).agg(*aggs) if aggs else windowed.select(*by).distinct()


def stream_window_agg(df: DataFrame, ts: str, size: str, keys: list, aggs: list[Column], slide: str | None = None) -> DataFrame:
    """Tumbling or hopping aggregation that closes by watermark: it groups by the window itself, which carries the watermark."""
    out = df.groupBy(*keys, F.window(ts, size, slide or size).alias("_w")).agg(*aggs)
    rest = [c for c in out.columns if c != "_w" and c not in keys]
    return out.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *rest)


def hop_agg(df: DataFrame, ts: str, slide: str, size: str, keys: list, partial: dict[str, tuple[Column, str]]) -> DataFrame:
    """Hopping aggregation by shared slices: rows are aggregated once per slide, then slices are fanned out.

    partial: output name -> (aggregate over rows, how slices merge: sum, min or max). Every
    row is shuffled, pre-aggregated, to one slice instead of being copied into each window.
    """
    slices = df.groupBy(*keys, F.window(ts, slide).alias("_s")).agg(*(a.alias(n) for n, (a, _) in partial.items()))
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    fanned = slices.withColumn("_t", F.col("_s.start"))
    out = fanned.groupBy(*keys, F.window("_t", size, slide).alias("_w")).agg(*(merge[how](n).alias(n) for n, (_, how) in partial.items()))
    return out.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *partial)


def cumulate_agg(df: DataFrame, ts: str, step: str, max_size: str, keys: list, partial: dict[str, tuple[Column, str]]) -> DataFrame:
    """Cumulating aggregation by shared slices: rows are aggregated once per step, then slices are merged into the windows that hold them.

    partial: as in hop_agg.
    """
    slices = df.groupBy(*keys, F.window(ts, step).alias("_s")).agg(*(a.alias(n) for n, (a, _) in partial.items()))
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    base = slices.withColumn("_t", F.col("_s.start")).withColumn("_b", F.window("_t", max_size))
    ends = F.expr(f"filter(sequence(_b.start + INTERVAL {step}, _b.end, INTERVAL {step}), e -> e > _t)")
    out = base.withColumn("window_end", F.explode(ends)).groupBy(*keys, F.col("_b.start").alias("window_start"), "window_end")
    return out.agg(*(merge[how](n).alias(n) for n, (_, how) in partial.items()))


def stream_session_agg(df: DataFrame, ts: str, gap: str, keys: list, aggs: list[Column]) -> DataFrame:
    """Sessions that close by watermark; df carries one on ts."""
    return session_agg(df, ts, gap, keys, aggs)


def stream_cumulate_agg(df: DataFrame, ts: str, step: str, max_size: str, keys: list, partial: dict[str, tuple[Column, str]]) -> DataFrame:
    """Cumulating windows on a stream: two chained stateful aggregations, by slice and then by window.

    All windows of a max_size bucket are emitted when the watermark passes its end.
    """
    slices = df.groupBy(*keys, F.window(ts, step).alias("_s")).agg(*(a.alias(n) for n, (a, _) in partial.items()))
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    base = slices.withColumn("_t", F.window_time("_s")).withColumn("_start", F.col("_s.start"))
    bucket = F.window("_t", max_size)
    placed = base.select("*", bucket.alias("_b"))
    ends = F.expr(f"filter(sequence(_b.start + INTERVAL {step}, _b.end, INTERVAL {step}), e -> e > _start)")
    out = placed.withColumn("window_end", F.explode(ends)).groupBy(*keys, "_b", "window_end").agg(*(merge[how](n).alias(n) for n, (_, how) in partial.items()))
    return out.select(*keys, F.col("_b.start").alias("window_start"), "window_end", *partial)


def session_agg(df: DataFrame, ts: str, gap: str, keys: list, aggs: list[Column]) -> DataFrame:
    """Sessions [first, last + gap); rows exactly gap apart share one."""
    out = df.groupBy(*keys, F.session_window(ts, gap).alias("_w")).agg(*aggs)
    rest = [c for c in out.columns if c != "_w" and c not in keys]
    return out.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), (F.col("_w.end") - F.expr("INTERVAL 1 MILLISECOND")).alias("window_time"), *rest)


def session_agg_sliced(df: DataFrame, ts: str, gap: str, keys: list, partial: dict[str, tuple[Column, str]], slice_size: str, tasks: int | None = None) -> DataFrame:
    """session_agg for keys that are few and hot: sessions of time slices, those at a slice's bounds then joined across them.

    partial: as in hop_agg. slice_size is to be many times the gap. A session more than the gap
    away from its slice's bounds is whole; of the others a key has two a slice at most, a small
    table. A key is so dealt to as many tasks as it has slices; tasks states their number,
    which is Spark's otherwise. Rows are dealt unaggregated, as few of them share a time.
    """
    by = [*keys, "_slice"]
    sliced = df.withColumn("_s", F.window(ts, slice_size)).withColumn("_slice", F.col("_s.start")).drop("_s")
    dealt = sliced.repartition(tasks, *by) if tasks else sliced.repartition(*by)
    own = dealt.groupBy(*by, F.session_window(ts, gap).alias("_w")).agg(F.min(ts).alias("_start"), F.max(ts).alias("_last"), *(a.alias(n) for n, (a, _) in partial.items()))
    # By the aggregated times, as Spark tests a condition on the session's own ones before rows are merged.
    wait, own = F.expr(f"INTERVAL {gap}"), own.withColumn("_s", F.window("_slice", slice_size))
    open_ = (F.col("_start") <= F.col("_s.start") + wait) | (F.col("_last") + wait >= F.col("_s.end"))
    own = own.withColumn("_end", F.col("_w.end"))
    order = Window.partitionBy(*keys).orderBy("_start")
    bounds = own.where(open_).withColumn("_new", F.coalesce(F.col("_start") > F.lag("_end").over(order), F.lit(True)).cast("long"))
    bounds = bounds.withColumn("_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    merged = bounds.groupBy(*keys, "_session").agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"), *(merge[how](n).cast(own.schema[n].dataType).alias(n) for n, (_, how) in partial.items()))
    rest = [*keys, "_start", "_end", *partial]
    out = own.where(~open_).select(*rest).unionByName(merged.select(*rest))
    return out.select(*keys, F.col("_start").alias("window_start"), F.col("_end").alias("window_end"), (F.col("_end") - F.expr("INTERVAL 1 MILLISECOND")).alias("window_time"), *partial)
