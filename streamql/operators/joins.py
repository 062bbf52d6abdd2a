"""Joins: regular, interval, window, temporal (as-of) and lookup."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamql.functions import times

#: A dimension of at most this many rows may be broadcast.
BROADCAST_ROWS = 100_000


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Equi join with an optional further condition, which must be true to match. NULL keys never match."""
    return left.join(right, on if residual is None else on & residual, how)


def interval_join(left: DataFrame, right: DataFrame, on: Column, l_ts: Column, r_ts: Column, lower: str, upper: str, how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Keys match and r_ts + lower <= l_ts <= r_ts + upper, both ends included.

    Time is cut into buckets as long as upper - lower, which join the key: a row of one side
    lies in one bucket, what it can match on the other side in two at most. So a hot key pairs
    rows of neighbouring buckets only, and its buckets are spread over the tasks. The side
    whose rows must all stay is the one that isn't copied; a full join is a left join and the
    right rows without a match.
    """
    near = (l_ts >= r_ts + F.expr(f"INTERVAL {lower}")) & (l_ts <= r_ts + F.expr(f"INTERVAL {upper}"))
    low, high = (times.interval_micros(left.sparkSession, x) for x in (lower, upper))
    width = max(high - low, 1_000_000)
    columns = [*left.columns, *right.columns]

    def bucket(side, ts, shift=0):
        return F.floor((times.micros(ts, side.select(ts).schema[0].dataType) + F.lit(shift)) / F.lit(width)).cast("long")

    def joined(kind):
        if kind.startswith("right"):
            one = right.withColumn("_r_bucket", bucket(right, r_ts))
            two = left.withColumn("_l_bucket", F.explode(F.array_distinct(F.array(bucket(left, l_ts, -high), bucket(left, l_ts, -low)))))
            a, z = two, one
        else:
            one = left.withColumn("_l_bucket", bucket(left, l_ts))
            two = right.withColumn("_r_bucket", F.explode(F.array_distinct(F.array(bucket(right, r_ts, low), bucket(right, r_ts, high)))))
            a, z = one, two
        return join(a, z, on & (F.col("_l_bucket") == F.col("_r_bucket")) & near, kind, residual)

    if how != "full":
        return joined(how).drop("_l_bucket", "_r_bucket")
    # A row of the right side that met none is one of its right join without a left bucket.
    unmet = joined("right").where("_l_bucket is null").drop("_l_bucket", "_r_bucket")
    return joined("left").drop("_l_bucket", "_r_bucket").toDF(*(f"c{i}" for i in range(len(columns)))).unionAll(unmet).toDF(*columns)


def window_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Both sides carry window_start and window_end; rows match on keys within equal windows."""
    on = (left["window_start"] == right["window_start"]) & (left["window_end"] == right["window_end"])
    for a, b in keys:
        on &= left[a] == right[b]
    return join(left, right, on, how, residual)


def temporal_join(probe: DataFrame, versions: DataFrame, key: tuple[str, str], probe_ts: str, version_ts: str, columns: dict[str, str], how: str = "inner", seq: str | None = None, row_kind: str | None = None) -> DataFrame:
    """The version valid at each probe row's time: of the same key, the latest with version_ts <= probe_ts.

    Both sides are sorted into one stream per key and the last version is carried forward:
    one shuffle by key and linear work, where a range join would pair each probe with all
    versions of its key. Of versions with one time the last by seq wins. A version whose
    row_kind is -U or -D ends validity. columns: version column -> output name.
    """
    dead = F.lit(False) if row_kind is None else F.coalesce(versions[row_kind].isin("-U", "-D"), F.lit(False))
    fields = [versions[c].alias(n) for c, n in columns.items()]
    v = versions.where(versions[key[1]].isNotNull() & versions[version_ts].isNotNull()).select(
        versions[key[1]].alias("_k"), versions[version_ts].alias("_t"), F.lit(0).alias("_side"), (versions[seq] if seq else F.lit(0)).cast("long").alias("_seq"),
        F.struct(F.lit(1).alias("_any"), (~dead).alias("_live"), *fields).alias("_v"), F.lit(None).cast(probe.schema).alias("_p"),
    )
    p = probe.select(
        probe[key[0]].alias("_k"), probe[probe_ts].alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_seq"),
        F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), F.struct(*probe.columns).alias("_p"),
    )
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = v.unionByName(p).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    live = F.col("_last._live") & F.col("_k").isNotNull() & F.col("_t").isNotNull()
    out = seen.where(live) if how == "inner" else seen
    return out.select("_p.*", *(F.when(live, F.col(f"_last.{n}")).alias(n) for n in columns.values()))


def lookup_join(probe: DataFrame, dim, on, how: str = "inner", *, schema: str | None = None, buffer: int = 100, workers: int = 1) -> DataFrame:
    """Join to a dimension table, or to a callable that looks keys up.

    dim as a DataFrame: a join, broadcast only if the dimension is small. dim as a callable
    key -> list of dicts of `schema`: called on the executors, once per distinct key of a
    batch, by `workers` threads with at most `buffer` keys under way (the asynchronous form).
    """
    if isinstance(dim, DataFrame):
        small = dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return probe.join(F.broadcast(dim) if small else dim, on, how)
    kinds = T._parse_datatype_string(schema)
    out_schema = T.StructType([*probe.schema.fields, *kinds.fields])

    def rows(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                asked = b.column(b.schema.get_field_index(on)).to_pylist()
                keys = list(dict.fromkeys(k for k in asked if k is not None))
                found = {}
                for a in range(0, len(keys), buffer):
                    part = keys[a : a + buffer]
                    found |= dict(zip(part, pool.map(dim, part)))
                at, hits = [], []
                for i, k in enumerate(asked):
                    mine = (found.get(k) or []) if k is not None else []
                    mine = mine or ([{}] if how == "left" else [])
                    at += [i] * len(mine)
                    hits += mine
                # Rows are taken as they are: no column leaves Arrow, so no number changes.
                kept = b.take(pa.array(at, pa.int64()))
                found_columns = [pa.array([h.get(f.name) for h in hits], to_arrow_type(f.dataType)) for f in kinds]
                yield pa.RecordBatch.from_arrays([*kept.columns, *found_columns], names=[*b.schema.names, *kinds.names])

    return probe.mapInArrow(rows, out_schema)
