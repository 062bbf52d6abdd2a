"""Calc, grouping sets, set operations, unnest and event-time sort."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calc(df: DataFrame, columns: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Projection with an optional filter: rows stay where the predicate is true."""
    return (df if where is None else df.where(where)).select(*(c.alias(n) for n, c in columns.items()))


def grouping_sets(df: DataFrame, sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[df[k] for k in s] for s in sets], *(df[k] for k in keys)).agg(*aggs)


def rollup(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    return df.rollup(*keys).agg(*aggs)


def cube(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    return df.cube(*keys).agg(*aggs)


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionAll(d)
    return out


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return union_all(*dfs).distinct()


def unnest(df: DataFrame, column: str, *, ordinality: str | None = None, left: bool = False, multiset: bool = False, where=None, names: list[str] | None = None) -> DataFrame:
    """One row per element of an array, map or multiset (a map element -> count).

    Inner: empty and null collections vanish; left: they give one padded row. Null rows in
    an array of rows are skipped, null scalars kept. where: element column(s) -> predicate,
    applied before padding. Ordinality counts emitted elements from 1.
    """
    kind = df.schema[column].dataType
    c = df[column]
    if multiset:
        c = F.flatten(F.transform(F.map_entries(c), lambda e: F.array_repeat(e["key"], e["value"])))
        fields = None
    elif kind.typeName() == "map":
        c, fields = F.map_entries(c), ["key", "value"]
    elif kind.elementType.typeName() == "struct":
        c, fields = F.filter(c, lambda e: e.isNotNull()), kind.elementType.names
    else:
        fields = None
    if where is not None:
        c = F.filter(c, where)
    emit = F.posexplode_outer if left else F.posexplode
    out = df.select("*", emit(c).alias("_pos", "_e"))
    names = names or fields or [f"{column}_element"]
    parts = [F.col("_e")[f].alias(n) for f, n in zip(fields, names)] if fields else [F.col("_e").alias(names[0])]
    if ordinality:
        parts.append((F.col("_pos") + 1).cast("int").alias(ordinality))
    return out.select(*(F.col(x) for x in df.columns), *parts)


def temporal_sort(df: DataFrame, ts: str, tiebreak: str) -> DataFrame:
    """Rows by event time; ties keep arrival order, which tiebreak states. A range sort, not one task."""
    return df.orderBy(F.col(ts).asc_nulls_first(), tiebreak)
