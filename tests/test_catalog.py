"""Every registered query with an oracle against DuckDB on the smallest driver tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from streamql.plans import catalog, nexmark

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    return repr(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL | nexmark.ORACLE_SQL))
def test_query(spark, duck, name):
    df = (catalog.QUERIES | nexmark.QUERIES)[name](spark, SF)
    rel = duck.sql((catalog.ORACLE_SQL | nexmark.ORACLE_SQL)[name])
    columns = sorted(rel.columns)
    assert sorted(df.columns) == columns
    want = sorted(tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_whole_joins_read_all_rows(spark, duck, how):
    got = catalog.QUERIES[f"join_{how}_whole"](spark, SF).collect()
    if how in ("left", "full"):
        assert len({r.o_orderkey for r in got} - {None}) == duck.sql("SELECT count(*) FROM orders").fetchall()[0][0]
    if how in ("right", "full"):
        assert len({r.c_custkey for r in got} - {None}) == duck.sql("SELECT count(*) FROM customer").fetchall()[0][0]
    assert any(r.o_orderkey is None for r in got) == (how in ("right", "full"))
    assert any(r.c_custkey is None for r in got) == (how in ("left", "full"))
