"""Value semantics at the edges of types, and the hand-made fixtures of the operators."""

import decimal

from pyspark.sql import functions as F

from streamql.functions import aggregates as A
from streamql.functions import expressions as E
from streamql.functions import udf
from streamql.operators import changelog, joins, rank, relational, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_integers_wrap(spark):
    big = F.lit(2**63 - 1)
    assert one(spark, E.add(big, F.lit(1))) == -(2**63)
    assert one(spark, E.multiply(big, big)) == 1 and one(spark, E.multiply(big, F.lit(3))) == 2**63 - 3 and one(spark, E.multiply(big, F.lit(-1))) == -(2**63) + 1
    assert one(spark, E.subtract(F.lit(-128), F.lit(1), "tinyint")) == 127
    assert one(spark, E.divide_int(F.lit(-7), F.lit(2))) == -3 and one(spark, E.modulo(F.lit(-7), F.lit(3))) == -1
    assert one(spark, E.narrow(F.lit(3000000000), "int")) == -1294967296


def test_floats(spark):
    inf, nan = float("inf"), float("nan")
    assert one(spark, E.divide_float(F.lit(1.0), F.lit(0.0))) == inf and one(spark, E.divide_float(F.lit(-1.0), F.lit(0.0))) == -inf
    assert one(spark, F.isnan(E.divide_float(F.lit(0.0), F.lit(0.0))))
    assert [one(spark, E.float_to_int(F.lit(x))) for x in (1e20, -1e20, nan, -2.9)] == [2**31 - 1, -(2**31), 0, -2]
    assert one(spark, E.float_to_int(F.lit(1e300), "bigint")) == 2**63 - 1
    assert one(spark, E.floor(F.lit(-2.5))) == -3.0 and one(spark, E.floor(F.lit(1e300))) == 1e300


def test_text_and_items(spark):
    assert one(spark, E.split_index(F.lit("a||b"), "|", 1)) == "" and one(spark, E.split_index(F.lit(""), "|", 0)) is None and one(spark, E.split_index(F.lit("a"), "|", 3)) is None
    assert one(spark, E.regexp_extract(F.lit("x"), "(y)", 1)) is None
    assert one(spark, E.item(F.array(F.lit(5)), 0)) is None and one(spark, E.item(F.array(F.lit(5)), 2)) is None and one(spark, E.item(F.array(F.lit(5)), 1)) == 5
    assert one(spark, E.to_char(F.lit("ab"), 4)) == "ab  " and one(spark, E.to_varchar(F.lit("abcdef"), 3)) == "abc"
    assert one(spark, E.decimal_op(F.lit(decimal.Decimal("1.005")), 3, 2)) == decimal.Decimal("1.01") and one(spark, E.decimal_op(F.lit(decimal.Decimal("123.4")), 3, 2)) is None


def test_aggregates(spark):
    df = spark.createDataFrame([(30000, "9.9"), (30000, "0.2")], "s smallint, d string")
    r = df.agg(A.sum_int(F.col("s"), "smallint").alias("s"), A.avg_int(-F.col("s").cast("int")).alias("a"), A.sum_decimal(F.col("d").cast("decimal(38,0)") * 9, 0).alias("d"), A.avg_decimal(F.col("d").cast("decimal(20,10)"), 10).alias("q")).first()
    assert r.s == -5536 and r.a == -30000 and r.q == decimal.Decimal("5.0500000000")
    big = spark.createDataFrame([(decimal.Decimal(10**38 - 1),), (decimal.Decimal(10**38 - 1),)], "d decimal(38,0)")
    assert big.agg(A.sum_decimal(F.col("d"), 0)).first()[0] is None


def test_unnest(spark):
    df = spark.createDataFrame([(1, [10, 20]), (2, []), (3, None), (4, [40, None])], "k int, vs array<int>")
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(relational.unnest(df, "vs", names=["v"]).select("k", "v")) == rows(spark.createDataFrame([(1, 10), (1, 20), (4, 40), (4, None)], "k int, v int"))
    assert len(rows(relational.unnest(df, "vs", left=True))) == 6
    ms = spark.createDataFrame([(1, {"a": 2, "b": 1})], "k int, m map<string,int>")
    assert sorted((r.m_element, r.o) for r in relational.unnest(ms, "m", multiset=True, ordinality="o").collect()) == [("a", 1), ("a", 2), ("b", 3)]
    rs = spark.createDataFrame([(3, [(40, "p"), None])], "k int, rs array<struct<a:int,b:string>>")
    assert rows(relational.unnest(rs, "rs", ordinality="o").select("a", "b", "o")) == [(40, "p", 1)]


def test_temporal_join_and_changelog(spark):
    orders = spark.createDataFrame([("USD", 1, 150), ("EUR", 2, 250), ("GBP", 4, 260), ("USD", 3, 450)], "currency string, amount int, ts int")
    rates = spark.createDataFrame([("USD", 10, 100, "+I"), ("EUR", 99, 100, "+I"), ("USD", 20, 300, "+U"), ("GBP", 7, 100, "+I"), ("GBP", 7, 200, "-D")], "currency string, rate int, ts int, row_kind string")
    run = lambda how: sorted((r.currency, r.amount, r.rate) for r in joins.temporal_join(orders, rates, ("currency", "currency"), "ts", "ts", {"rate": "rate"}, how, row_kind="row_kind").collect())
    assert run("inner") == [("EUR", 2, 99), ("USD", 1, 10), ("USD", 3, 20)] and ("GBP", 4, None) in run("left")
    log = spark.createDataFrame([("+I", 1, 10, 0), ("+U", 1, 20, 1), ("+I", 2, 5, 2), ("+U", 2, 5, 3), ("-D", 1, 20, 4), ("+I", 3, 7, 5)], "row_kind string, k int, v int, seq int")
    assert sorted((r.k, r.v) for r in changelog.normalize(log, ["k"], "seq").collect()) == [(2, 5), (3, 7)]
    old, new = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k int, v int"), spark.createDataFrame([(1, 1), (2, 5), (4, 4)], "k int, v int")
    assert sorted(map(tuple, changelog.difference(old, new, ["k"]).collect())) == [("+I", 4, 4), ("+U", 2, 5), ("-D", 3, 3), ("-U", 2, 2)]


def test_session_merges_out_of_order_rows(spark):
    df = spark.sql("SELECT v, TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, ms / 1000.0) AS ts FROM VALUES (1, 0), (2, 1500), (4, 700), (9, 5000) t(v, ms)")
    assert sorted(r.s for r in windows.session_agg(df, "ts", "1 second", [], [F.sum("v").alias("s")]).collect()) == [7, 9]
    assert rank.dedup(df.withColumn("k", F.lit(1)).withColumn("seq", F.col("v")), ["k"], "ts", "seq", "last").first().v == 9


def test_scalar_function(spark):
    f = udf.scalar_function("plus_one", lambda x: None if x is None else x + 1, "bigint")
    assert [r.y for r in spark.createDataFrame([(1,), (None,)], "x bigint").select(f(F.col("x")).alias("y")).collect()] == [2, None]
    udf.register_sql(spark, "twice", lambda x: x * 2, "bigint")
    assert spark.sql("SELECT twice(id) AS y FROM range(2)").collect()[1].y == 2


def test_decimal_quotients(spark):
    wide = lambda x: F.lit(decimal.Decimal(x)).cast("decimal(38,10)")
    assert one(spark, E.decimal_div(wide("1"), wide("3"), 38, 18)) == decimal.Decimal("0.333333333333333333")
    assert one(spark, E.decimal_div(wide("2"), wide("-3"), 10, 2)) == decimal.Decimal("-0.67") and one(spark, E.decimal_div(wide("5000"), wide("1"), 4, 2)) is None
    assert one(spark, E.decimal_mod(wide("-7.5"), wide("2"), 10, 2)) == decimal.Decimal("-1.50")
    for f in (E.decimal_div, E.decimal_mod):
        try:
            one(spark, f(wide("1"), wide("0"), 10, 2))
            raise AssertionError
        except Exception as e:
            assert "division by zero" in str(e)


def test_lookups_keep_every_digit(spark):
    df = spark.createDataFrame([(1, 2**53 + 1), (2, None), (3, -(2**63))], "k long, big long").coalesce(1)
    got = joins.lookup_join(df, lambda k: [{"d": decimal.Decimal(k), "big2": 2**62 + k}] * k if k < 3 else [], "k", "left", schema="d decimal(10,2), big2 bigint")
    want = [(1, 2**53 + 1, decimal.Decimal(1), 2**62 + 1)] + [(2, None, decimal.Decimal(2), 2**62 + 2)] * 2 + [(3, -(2**63), None, None)]
    assert [tuple(r) for r in got.collect()] == want


def test_interval_join_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    side = lambda n: [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(0, 40)])) for i in range(n)]
    a, b = side(60), side(50)
    frame = lambda rows, names: spark.createDataFrame(rows, f"{names[0]} long, {names[1]} long, {names[2]} long").withColumn(names[2], F.timestamp_seconds(names[2]).cast("timestamp_ntz"))
    left, right = frame(a, ("a", "ka", "ta")), frame(b, ("b", "kb", "tb"))
    hit = lambda x, y: x[1] == y[1] and None not in (x[1], x[2], y[2]) and y[2] - 7 <= x[2] <= y[2] + 3
    pairs = [(x[0], y[0]) for x in a for y in b if hit(x, y)]
    lone = {"left": [(x[0], None) for x in a if not any(hit(x, y) for y in b)], "right": [(None, y[0]) for y in b if not any(hit(x, y) for x in a)]}
    lone |= {"inner": [], "full": lone["left"] + lone["right"]}
    for how in ("inner", "left", "right", "full"):
        got = joins.interval_join(left, right, left["ka"] == right["kb"], left["ta"], right["tb"], "-7 SECONDS", "3 SECONDS", how)
        assert got.columns == ["a", "ka", "ta", "b", "kb", "tb"]
        assert sorted(map(str, ((r.a, r.b) for r in got.collect()))) == sorted(map(str, pairs + lone[how])), how
    plan = joins.interval_join(left, right, left["ka"] == right["kb"], left["ta"], right["tb"], "-7 SECONDS", "3 SECONDS")._jdf.queryExecution().optimizedPlan().toString()
    assert "_l_bucket" in plan and "_r_bucket" in plan


def test_interval_frames_are_two_running_aggregates(spark):
    import random

    from streamql.plans import catalog

    rng = random.Random(7)
    # Times before 1970, at the slices' bounds, one microsecond beside them, equal ones and none; a key that is null.
    times = [None, *range(-12_000_000, 12_000_001, 1_000_000), *(5_000_000 * i + d for i in (-2, -1, 0, 1, 2) for d in (-1, 1))]
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice(times), rng.choice([None, 1, 2, 3, 9]), rng.choice([None, 0.5, float("nan"), -2.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, m long, v int, x double")
    aggs = {"n": (F.count("*"), "sum"), "c": (F.count("v"), "sum"), "s": (F.sum("v"), "sum"), "d": (F.sum(F.col("v").cast("decimal(5,2)")), "sum"), "lo": (F.min("v"), "min"), "hi": (F.max("x"), "max")}
    for kind in ("timestamp", "timestamp_ntz"):
        t = df.withColumn("ts", F.timestamp_micros("m").cast(kind))
        got = rank.over_interval(t, ["k"], "ts", aggs, "5 SECONDS")
        want = rank.over(t, ["k"], "ts", {n: a for n, (a, _) in aggs.items()}, ("range", "5 SECONDS"))
        assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, rank.over_interval(t, ["k"], "ts", aggs, "0 SECONDS").collect())) == sorted(map(str, rank.over(t, ["k"], "ts", {n: a for n, (a, _) in aggs.items()}, ("range", "0 SECONDS")).collect()))
    # A frame of an interval would take up all its rows again for each row, in as many tasks as there are keys.
    plan = catalog.QUERIES["over_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, -" not in plan and "_slice" in plan


def test_sliced_sessions_join_across_slices(spark):
    import random

    from streamql.plans import nexmark

    rng = random.Random(11)
    rows = [(k, rng.choice([None, 1, 2, 9]), m) for k in ("a", "b", None) for m in [None, *(rng.randrange(-40_000, 40_000) for _ in range(60)), *range(-13_000, 14_000, 1_000), *range(19_001, 27_000, 1_001), 9_999, 10_000, -10_000]]
    df = spark.createDataFrame(rows, "k string, v int, ms long")
    aggs = {"n": (F.count("*"), "sum"), "s": (F.sum("v"), "sum"), "d": (F.sum(F.col("v").cast("decimal(5,2)")), "sum"), "lo": (F.min("v"), "min"), "hi": (F.max("v"), "max")}
    for kind in ("timestamp", "timestamp_ntz"):
        t = df.withColumn("ts", F.timestamp_millis("ms").cast(kind))
        # Gaps below, at and above the slice; sessions over several slices, and over none but their own.
        for gap, size in (("1 second", "10 seconds"), ("1 second", "5 seconds"), ("2 seconds", "2 seconds"), ("3 seconds", "1 second"), ("200 milliseconds", "10 seconds")):
            want = windows.session_agg(t, "ts", gap, ["k"], [a.alias(n) for n, (a, _) in aggs.items()])
            for tasks in (None, 3):
                got = windows.session_agg_sliced(t, "ts", gap, ["k"], aggs, size, tasks)
                assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect())), (kind, gap, size)
    # Tasks grow with the stream, and its 46 bidders are dealt to all of them.
    e = nexmark.stream(spark, 20 * nexmark.PER_TASK)
    assert nexmark.tasks(e) == 20
    got = windows.session_agg_sliced(nexmark.bid(nexmark.stream(spark, 3_000_000)), "dateTime", "900 milliseconds", ["bidder"], {"n": (F.count("*"), "sum")}, "1 HOUR", 20)
    assert "hashpartitioning(bidder" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "_slice" in plan and "REPARTITION_BY_NUM" in plan


def test_distinct_auctions_are_counted_in_as_many_tasks_as_the_stream_has(spark):
    from streamql.plans import nexmark

    e = nexmark.stream(spark, 20 * nexmark.PER_TASK)
    for keys in (["day"], ["channel", "day"]):
        plan = nexmark._stats(e, keys)._jdf.queryExecution().executedPlan().toString()
        assert any("auction#" in line and ", 20), REPARTITION_BY_NUM" in line for line in plan.split("\n")), keys
        # The auctions are not copied beside the bidders for one shuffle of all distinct values.
        assert not any("Expand" in line and "auction#" in line for line in plan.split("\n")), keys


def test_topn_of_the_stream_is_dealt_to_its_tasks(spark, monkeypatch):
    from streamql.plans import nexmark

    sf = "/root/testdata/sf0.001"
    few = {q: sorted(map(str, nexmark.QUERIES[q](spark, sf).collect())) for q in ("nexmark_q11", "nexmark_q16", "nexmark_q19")}
    monkeypatch.setattr(nexmark, "PER_TASK", 1_000)  # 20 tasks
    plan = nexmark.QUERIES["nexmark_q19"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and any("auction#" in line and ", 20), REPARTITION_BY_NUM" in line for line in plan.split("\n")), plan
    for q, rows in few.items():
        assert sorted(map(str, nexmark.QUERIES[q](spark, sf).collect())) == rows, q
