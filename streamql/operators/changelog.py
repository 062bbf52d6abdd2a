"""Changelogs: rows with a row_kind of +I, -U, +U or -D."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KIND = "row_kind"
ADDS, TAKES = ("+I", "+U"), ("-U", "-D")


def collapse(df: DataFrame) -> DataFrame:
    """The table a changelog amounts to: each row as often as it was added more than taken away."""
    columns = [c for c in df.columns if c != KIND]
    net = F.sum(F.when(F.col(KIND).isin(*TAKES), -1).otherwise(1))
    counted = df.groupBy(*columns).agg(net.alias("_n")).where("_n > 0")
    return counted.withColumn("_x", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).select(*columns)


def normalize(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The final row per key of an upsert stream: its last by seq, unless that deletes. -U rows carry no news."""
    rest = [c for c in df.columns if c not in (*keys, KIND)]
    row = F.struct(F.col(KIND).alias("_k"), F.struct(*rest).alias("_r"))
    last = df.where(F.col(KIND) != "-U").groupBy(*keys).agg(F.max_by(row, F.struct(F.col(seq))).alias("_b"))
    return last.where(F.col("_b._k") != "-D").select(*keys, "_b._r.*").select(*(c for c in df.columns if c != KIND))


def comparable(x: Column, kind: T.DataType) -> Column:
    """A value that is equal where x is: maps, which Spark doesn't compare, become entries sorted by key."""
    if isinstance(kind, T.MapType):
        entries = F.map_entries(x)
        if _has_map(kind.valueType):
            entries = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), comparable(e["value"], kind.valueType).alias("value")))
        return F.sort_array(entries)
    if not _has_map(kind):
        return x
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: comparable(e, kind.elementType))
    return F.when(x.isNotNull(), F.struct(*(comparable(x[f.name], f.dataType).alias(f.name) for f in kind)))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def difference(old: DataFrame, new: DataFrame, keys: list[str], emit_update_before: bool = True) -> DataFrame:
    """The changelog that turns table old into new, both unique by keys; unchanged rows give nothing."""
    columns = new.columns
    a = old.select(*keys, F.struct(*columns).alias("_a"))
    b = new.select(*keys, F.struct(*columns).alias("_b"))
    kind = new.select(*columns).schema
    both = a.join(b, keys, "full").where(~comparable(F.col("_a"), kind).eqNullSafe(comparable(F.col("_b"), kind)))
    entry = lambda kind, row: F.struct(F.lit(kind).alias(KIND), row.alias("row"))
    changed = F.array(entry("-U", F.col("_a")), entry("+U", F.col("_b"))) if emit_update_before else F.array(entry("+U", F.col("_b")))
    rows = F.when(F.col("_a").isNull(), F.array(entry("+I", F.col("_b")))).when(F.col("_b").isNull(), F.array(entry("-D", F.col("_a")))).otherwise(changed)
    return both.select(F.inline(rows)).select(KIND, "row.*")
