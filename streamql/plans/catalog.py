"""Registered queries over the driver tables, each with its DuckDB oracle."""

from pyspark.sql import functions as F

from streamql.functions import aggregates as A
from streamql.functions import expressions as E
from streamql.operators import changelog, joins, rank, relational, windows
from streamql.sources import formats

QUERIES = {}
ORACLE_SQL = {}


def query(name, sql):
    """Register f(spark, sf_dir) under ``name`` with its oracle."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def simple(name, source, build, sql):
    """A query over one table."""
    query(name, sql)(lambda spark, sf_dir: build(table(spark, sf_dir, source)))


c = F.col

# Projection, filter and scalar expressions.

simple("calc_filter", "events", lambda e: relational.calc(e, {"event_id": c("event_id"), "double_value": c("value") * 2}, (c("value") > 50) & (c("user_id") % 7 != 3)),
       "SELECT event_id, value * 2 AS double_value FROM events WHERE value > 50 AND user_id % 7 <> 3")
simple("decimal_mul", "lineitem", lambda t: t.select("l_orderkey", "l_linenumber", E.decimal_op(c("l_extendedprice").cast("decimal(15,2)") * F.lit("0.908").cast("decimal(4,3)"), 23, 3).alias("price")),
       "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST('0.908' AS DECIMAL(4,3)) AS DECIMAL(23,3)) AS price FROM lineitem")
simple("int_div_mod", "events", lambda e: e.select("event_id", E.divide_int(c("user_id") - 50, F.lit(7)).alias("q"), E.modulo(c("user_id") - 50, F.lit(7)).alias("r")),
       "SELECT event_id, (user_id - 50) // 7 AS q, (user_id - 50) % 7 AS r FROM events")
simple("int_wrap", "events", lambda e: e.select("event_id", E.multiply(c("event_id").cast("int"), F.lit(1000003), "int").alias("m"), E.add(c("event_id"), F.lit(30000), "smallint").alias("s")),
       """SELECT event_id, ((((event_id::HUGEINT * 1000003 + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648)::INTEGER AS m,
          (((event_id + 30000 + 32768) % 65536) - 32768)::SMALLINT AS s FROM events""")
simple("float_div", "lineitem", lambda t: t.select("l_orderkey", "l_linenumber", E.divide_float(c("l_extendedprice"), c("l_discount")).alias("x")).where(F.abs("x") < float("inf")).withColumn("x", F.round("x", 4)),
       "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice / l_discount, 4) AS x FROM lineitem WHERE l_discount <> 0")
simple("case_coalesce", "events", lambda e: e.select("event_id", F.when(c("value") > 80, "high").when(c("value") > 20, "mid").otherwise("low").alias("band"), F.coalesce(F.when(c("user_id") % 2 == 0, c("user_id")), F.lit(-1)).alias("even")),
       "SELECT event_id, CASE WHEN value > 80 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS band, COALESCE(CASE WHEN user_id % 2 = 0 THEN user_id END, -1) AS even FROM events")
simple("null_logic", "events", lambda e: e.select("event_id", F.when(c("value") > 50, True).when(c("value") < 10, False).alias("b")).select("event_id", c("b").isNull().alias("unknown"), c("b").eqNullSafe(True).alias("is_true"), (~c("b")).eqNullSafe(True).alias("is_false")),
       "SELECT event_id, b IS NULL AS unknown, b IS NOT DISTINCT FROM TRUE AS is_true, b IS NOT DISTINCT FROM FALSE AS is_false FROM (SELECT event_id, CASE WHEN value > 50 THEN TRUE WHEN value < 10 THEN FALSE END AS b FROM events)")
simple("like_between_in", "part", lambda p: p.where(c("p_name").like("%a%") & c("p_size").between(5, 25) & ~c("p_brand").isin("Brand#11", "Brand#22")).select("p_partkey", "p_size"),
       "SELECT p_partkey, p_size FROM part WHERE p_name LIKE '%a%' AND p_size BETWEEN 5 AND 25 AND p_brand NOT IN ('Brand#11', 'Brand#22')")
simple("string_fns", "customer", lambda t: t.select(
        "c_custkey", F.upper("c_name").alias("u"), F.char_length("c_name").cast("bigint").alias("n"), F.substring("c_name", 3, 5).alias("sub"), F.position(F.lit("#"), c("c_name")).cast("bigint").alias("pos"), F.replace(c("c_name"), F.lit("0"), F.lit("o")).alias("rep"),
        F.reverse("c_name").alias("rev"), F.repeat("c_mktsegment", 2).alias("twice"), F.left("c_name", F.lit(4)).alias("l"), F.right("c_name", F.lit(4)).alias("r"), F.lpad("c_mktsegment", 12, "*").alias("lp"), F.rpad("c_mktsegment", 4, "*").alias("rp"), F.trim(F.concat(F.lit("  "), c("c_name"), F.lit(" "))).alias("t"), F.ascii("c_name").cast("bigint").alias("a")),
       """SELECT c_custkey, upper(c_name) AS u, length(c_name)::BIGINT AS n, substring(c_name, 3, 5) AS sub, position('#' IN c_name)::BIGINT AS pos, replace(c_name, '0', 'o') AS rep, reverse(c_name) AS rev, repeat(c_mktsegment, 2) AS twice,
          left(c_name, 4) AS l, right(c_name, 4) AS r, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 4, '*') AS rp, trim('  ' || c_name || ' ') AS t, ascii(c_name)::BIGINT AS a FROM customer""")
simple("split_index", "pages", lambda p: p.select("page_id", E.split_index(c("url"), "/", 2).alias("host"), E.split_index(c("url"), "/", 9).alias("none")),
       "SELECT page_id, CASE WHEN url <> '' THEN string_split(url, '/')[3] END AS host, CASE WHEN url <> '' THEN string_split(url, '/')[10] END AS none FROM pages")
simple("regexp_extract", "events", lambda e: e.select("event_id", E.regexp_extract(c("props"), r'"k": (\d)5', 1).alias("d")),
       """SELECT event_id, CASE WHEN regexp_matches(props, '"k": (\\d)5') THEN regexp_extract(props, '"k": (\\d)5', 1) END AS d FROM events""".replace("\\\\", "\\"))
simple("date_format", "events", lambda e: e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("s")), "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s FROM events")
simple("extract_fields", "events", lambda e: e.select("event_id", *(E.extract(u, c("ts")).alias(u) for u in ("year", "month", "day", "hour", "minute", "second"))),
       "SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second FROM events")
simple("narrowing_cast", "events", lambda e: e.select("event_id", E.narrow(c("event_id") * 37, "tinyint").alias("b"), E.float_to_int(c("value") * 1e8, "int").alias("i"), E.float_to_int(-c("value"), "bigint").alias("l")),
       "SELECT event_id, ((event_id * 37 + 128) % 256 - 128)::TINYINT AS b, CAST(least(trunc(value * 1e8), 2147483647) AS INTEGER) AS i, CAST(trunc(-value) AS BIGINT) AS l FROM events")
simple("char_varchar", "part", lambda p: p.select("p_partkey", E.to_char(c("p_brand"), 12).alias("ch"), E.to_varchar(c("p_type"), 6).alias("vc")),
       "SELECT p_partkey, rpad(p_brand, 12, ' ') AS ch, left(p_type, 6) AS vc FROM part")
simple("float_fns", "supplier", lambda t: t.select("s_suppkey", F.abs("s_acctbal").alias("a"), E.floor(c("s_acctbal")).alias("f"), E.ceil(c("s_acctbal")).alias("ce"), F.signum("s_acctbal").alias("sg"), F.round("s_acctbal", 1).alias("r"), F.round(F.sqrt(F.abs("s_acctbal")), 6).alias("sq"), F.round(F.ln(F.abs("s_acctbal") + 1), 6).alias("ln"), F.round(F.pow(F.lit(1.01), c("s_suppkey") % 50), 6).alias("pw")),
       "SELECT s_suppkey, abs(s_acctbal) AS a, floor(s_acctbal) AS f, ceil(s_acctbal) AS ce, sign(s_acctbal)::DOUBLE AS sg, round(s_acctbal, 1) AS r, round(sqrt(abs(s_acctbal)), 6) AS sq, round(ln(abs(s_acctbal) + 1), 6) AS ln, round(pow(1.01, s_suppkey % 50), 6) AS pw FROM supplier")
simple("interval_arithmetic", "events", lambda e: e.select("event_id", (c("ts") + F.expr("INTERVAL 90 MINUTES")).alias("later"), (c("ts") - F.expr("INTERVAL 2 DAYS")).alias("earlier")),
       "SELECT event_id, ts + INTERVAL 90 MINUTE AS later, ts - INTERVAL 2 DAY AS earlier FROM events")
simple("json_props", "events", lambda e: e.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k")), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
simple("field_access", "events", lambda e: e.select("event_id", F.struct(c("user_id"), F.when(c("value") > 10, F.struct(c("value"))).alias("inner")).alias("s")).select("event_id", "s.user_id", "s.inner.value"),
       "SELECT event_id, user_id, CASE WHEN value > 10 THEN value END AS value FROM events")
simple("subscripts", "events", lambda e: e.select("event_id", F.array("user_id", "event_id").alias("a"), F.create_map(c("event_type"), c("value")).alias("m")).select("event_id", E.item(c("a"), 2).alias("second"), E.item(c("a"), 5).alias("none"), E.item(c("m"), "click", "map").alias("click")),
       "SELECT event_id, event_id AS second, NULL::BIGINT AS none, CASE WHEN event_type = 'click' THEN value END AS click FROM events")
simple("count_char", "customer", lambda t: t.select("c_custkey", E.count_char(c("c_name"), "0").alias("zeros")), "SELECT c_custkey, (length(c_name) - length(replace(c_name, '0', '')))::BIGINT AS zeros FROM customer")

# Aggregation.

simple("group_sum_avg", "lineitem", lambda t: t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.avg("l_discount"), 6).alias("d"), F.count("*").alias("n"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi")),
       "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(l_discount), 6) AS d, COUNT(*) AS n, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem GROUP BY ALL")
simple("sum_int_wrap", "lineitem", lambda t: t.groupBy("l_returnflag").agg(A.sum_int(c("l_linenumber") * 100003, "int").alias("s"), A.sum_int(c("l_orderkey"), "smallint").alias("t")),
       """SELECT l_returnflag, (((SUM(l_linenumber * 100003)::HUGEINT + 2147483648) % 4294967296) - 2147483648)::INTEGER AS s, (((SUM(l_orderkey)::HUGEINT + 32768) % 65536) - 32768)::SMALLINT AS t FROM lineitem GROUP BY ALL""")
simple("avg_trunc_int", "events", lambda e: e.groupBy("event_type").agg(A.avg_int(c("user_id") - 600).alias("a")), "SELECT event_type, CAST(SUM(user_id - 600) // COUNT(*) AS BIGINT) AS a FROM events GROUP BY ALL")
simple("sum_decimal38", "orders", lambda t: t.groupBy("o_orderpriority").agg(A.sum_decimal(c("o_totalprice").cast("decimal(12,2)"), 2).alias("s")),
       "SELECT o_orderpriority, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS s FROM orders GROUP BY ALL")
simple("avg_decimal38", "orders", lambda t: t.groupBy("o_orderpriority").agg(A.avg_decimal(c("o_totalprice").cast("decimal(12,2)"), 2).cast("double").alias("a")).withColumn("a", F.round("a", 4)),
       "SELECT o_orderpriority, ROUND(AVG(CAST(o_totalprice AS DECIMAL(12,2)))::DOUBLE, 4) AS a FROM orders GROUP BY ALL")
simple("filter_agg", "events", lambda e: e.groupBy("user_id").agg(A.count(where=c("value") > 50).alias("n"), A.count(c("event_type"), where=c("value") > 20, distinct=True).alias("d"), F.round(F.sum(F.when(c("event_type") == "click", c("value"))), 4).alias("s")),
       "SELECT user_id, COUNT(*) FILTER (WHERE value > 50) AS n, COUNT(DISTINCT event_type) FILTER (WHERE value > 20) AS d, ROUND(SUM(value) FILTER (WHERE event_type = 'click'), 4) AS s FROM events GROUP BY ALL")
simple("count_distinct", "events", lambda e: e.groupBy("event_type").agg(A.count(c("user_id"), distinct=True).alias("n")), "SELECT event_type, COUNT(DISTINCT user_id) AS n FROM events GROUP BY ALL")
simple("sum_distinct", "lineitem", lambda t: t.groupBy("l_returnflag").agg(A.sum_int(c("l_suppkey"), distinct=True).alias("s")), "SELECT l_returnflag, SUM(DISTINCT l_suppkey)::BIGINT AS s FROM lineitem GROUP BY ALL")
simple("group_by_array", "events", lambda e: e.groupBy(F.array(c("event_type"), (c("user_id") % 3).cast("string")).alias("k")).agg(F.count("*").alias("n")).select(F.array_join("k", "/").alias("k"), "n"),
       "SELECT event_type || '/' || (user_id % 3)::VARCHAR AS k, COUNT(*) AS n FROM events GROUP BY ALL")
simple("distinct", "orders", lambda t: t.select("o_orderstatus", "o_orderpriority").distinct(), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_SETS = "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY {}"
simple("grouping_sets", "lineitem", lambda t: relational.grouping_sets(t, [["l_returnflag"], ["l_linestatus"], []], [F.count("*").alias("n"), F.grouping_id().alias("g")]),
       "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, GROUPING(l_returnflag, l_linestatus)::BIGINT AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
simple("cube", "lineitem", lambda t: relational.cube(t, ["l_returnflag", "l_linestatus"], [F.count("*").alias("n")]), _SETS.format("CUBE (l_returnflag, l_linestatus)"))
simple("rollup", "lineitem", lambda t: relational.rollup(t, ["l_returnflag", "l_linestatus"], [F.count("*").alias("n")]), _SETS.format("ROLLUP (l_returnflag, l_linestatus)"))

# Set operations.

_A, _B = "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0"


def _two(f):
    def run(spark, sf_dir):
        a = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(c("o_custkey").alias("k"))
        return f(a, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(c("c_custkey").alias("k")))

    return run


for _name, _f, _op in [
    ("union_all", relational.union_all, "UNION ALL"), ("union_distinct", relational.union_distinct, "UNION"), ("intersect_", lambda a, b: a.intersect(b), "INTERSECT"), ("except_", lambda a, b: a.subtract(b), "EXCEPT"),
    ("intersect_all", lambda a, b: a.intersectAll(b), "INTERSECT ALL"), ("except_all", lambda a, b: a.exceptAll(b), "EXCEPT ALL"),
]:
    query(_name, f"{_A} {_op} {_B}")(_two(_f))

# Windows.

def _aggs():
    return [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")]


def _hours(t):
    return windows.tumble(t, "ts", "1 hour")


simple("tumble", "events", lambda e: windows.window_agg(_hours(e), ["event_type"], _aggs()),
       "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY ALL")
simple("tumble_tvf", "events", lambda e: _hours(e).select("event_id", "window_start", "window_end", "window_time"),
       "SELECT event_id, time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' - INTERVAL '1 millisecond' AS window_time FROM events")
_HOP = "WITH w AS (SELECT *, unnest([time_bucket(INTERVAL '1 hour', ts) - INTERVAL (i) HOUR FOR i IN range(3)]) AS window_start FROM events) SELECT event_type, window_start, window_start + INTERVAL 3 HOUR AS window_end, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM w GROUP BY ALL"
simple("hop", "events", lambda e: windows.window_agg(windows.hop(e, "ts", "1 hour", "3 hours"), ["event_type"], _aggs()), _HOP)
simple("hop_sliced", "events", lambda e: windows.hop_agg(e, "ts", "1 hour", "3 hours", ["event_type"], {"n": (F.count("*"), "sum"), "total": (F.sum("value"), "sum")}).withColumn("total", F.round("total", 4)), _HOP)
simple("cumulate", "events", lambda e: windows.window_agg(windows.cumulate(e, "ts", "1 hour", "4 hours"), ["event_type"], _aggs()),
       """WITH b AS (SELECT *, time_bucket(INTERVAL '4 hours', ts) AS window_start FROM events), w AS (SELECT *, window_start + unnest([1, 2, 3, 4]) * INTERVAL 1 HOUR AS window_end FROM b)
          SELECT event_type, window_start, window_end, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM w WHERE window_end > ts GROUP BY ALL""")
_SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) """
simple("session", "events", lambda e: windows.session_agg(e, "ts", "30 minutes", ["user_id"], _aggs()),
       _SESSIONS + "SELECT user_id, MIN(ts) AS window_start, MAX(ts) + INTERVAL 30 MINUTE AS window_end, MAX(ts) + INTERVAL 30 MINUTE - INTERVAL 1 MILLISECOND AS window_time, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM s GROUP BY user_id, sid")
simple("window_distinct", "events", lambda e: windows.window_agg(_hours(e), ["user_id"], []), "SELECT DISTINCT user_id, time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end FROM events")
simple("window_count_distinct", "events", lambda e: windows.window_agg(_hours(e), [], [F.count_distinct("user_id").alias("users")]),
       "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, COUNT(DISTINCT user_id) AS users FROM events GROUP BY ALL")
_PER = "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, COUNT(*) AS n FROM events GROUP BY ALL"


def _per_window(e):
    return windows.window_agg(_hours(e), ["event_type"], [F.count("*").alias("n")])


simple("window_reagg", "events", lambda e: windows.window_agg(_per_window(e), [], [F.max("n").alias("most")]), f"SELECT window_start, window_end, MAX(n) AS most FROM ({_PER}) GROUP BY ALL")
simple("window_topn", "events", lambda e: rank.window_topn(_per_window(e), [], [F.desc("n"), F.asc("event_type")], 2, rank_col="rn"),
       f"SELECT *, row_number() OVER (PARTITION BY window_start, window_end ORDER BY n DESC, event_type) AS rn FROM ({_PER}) QUALIFY rn <= 2")
simple("window_dedup", "events", lambda e: rank.dedup(_hours(e).select("user_id", "window_start", "window_end", "ts", "event_id"), ["window_start", "window_end", "user_id"], "ts", "event_id", "last"),
       "SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts DESC, event_id DESC) = 1")

# OVER, ranking, deduplication, sort.

simple("over_running", "events", lambda e: rank.over(e, ["user_id"], "ts", {"s": F.sum("value"), "n": F.count("value"), "lo": F.min("value"), "hi": F.max("value")}).select("event_id", F.round("s", 4).alias("s"), "n", "lo", "hi"),
       "SELECT event_id, ROUND(SUM(value) OVER w, 4) AS s, COUNT(value) OVER w AS n, MIN(value) OVER w AS lo, MAX(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING)")
simple("over_rows", "events", lambda e: rank.over(e.withColumn("o", F.struct("ts", "event_id")), ["user_id"], "o", {"s": F.sum("event_id")}, ("rows", 3)).select("event_id", "s"),
       "SELECT event_id, (SUM(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 3 PRECEDING))::BIGINT AS s FROM events")
simple("over_range", "events", lambda e: rank.over_interval(e, ["event_type"], "ts", {"n": (F.count("*"), "sum"), "hi": (F.max("value"), "max")}, "2 HOURS").select("event_id", "n", "hi"),
       "SELECT event_id, COUNT(*) OVER w AS n, MAX(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW)")
simple("over_avg_int", "events", lambda e: rank.over(e, ["event_type"], "ts", {"s": F.sum(c("user_id") - 600), "n": F.count("user_id")}).select("event_id", E.divide_int(c("s"), c("n")).alias("a")),
       "SELECT event_id, CAST((SUM(user_id - 600) OVER w) // (COUNT(*) OVER w) AS BIGINT) AS a FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE UNBOUNDED PRECEDING)")
simple("over_rank", "orders", lambda t: rank.over(t.withColumn("o", F.to_date("o_orderdate")), ["o_orderpriority"], "o", {"rk": F.rank(), "dr": F.dense_rank()}, ("rows", None)).select("o_orderkey", "rk", "dr"),
       "SELECT o_orderkey, (rank() OVER w)::INTEGER AS rk, (dense_rank() OVER w)::INTEGER AS dr FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate::DATE)")
simple("first_last_value", "events", lambda e: rank.over(e.withColumn("v", F.when(c("value") > 30, c("value"))).withColumn("o", F.struct("ts", "event_id")), ["user_id"], "o", {"f": A.first_value(c("v")), "l": A.last_value(c("v"))}, ("rows", None)).select("event_id", "f", "l"),
       "SELECT event_id, first_value(v IGNORE NULLS) OVER w AS f, last_value(v IGNORE NULLS) OVER w AS l FROM (SELECT *, CASE WHEN value > 30 THEN value END AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
simple("topn", "events", lambda e: rank.topn(e, ["event_type"], [F.desc("value"), F.asc("event_id")], 5, rank_col="rn").select("event_type", "event_id", "value", "rn"),
       "SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events QUALIFY rn <= 5")
simple("topn_offset", "events", lambda e: rank.topn(e, ["user_id"], [F.asc_nulls_first("value"), F.asc("event_id")], 4, offset=2).select("user_id", "event_id"),
       "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value NULLS FIRST, event_id) BETWEEN 3 AND 4")
simple("topn_of_aggregate", "lineitem", lambda t: rank.topn(t.groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n")), ["l_returnflag"], [F.desc("n"), F.asc("l_suppkey")], 3),
       "SELECT * FROM (SELECT l_returnflag, l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey) <= 3")
simple("limit_sorted", "orders", lambda t: rank.limit(t, 20, [F.desc("o_totalprice"), F.asc("o_orderkey")], 5).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
_DEDUP = "SELECT user_id, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts {0}, event_id {0}) = 1"
simple("dedup_first", "events", lambda e: rank.dedup(e.select("user_id", "event_id", "ts", "value"), ["user_id"], "ts", "event_id"), _DEDUP.format("ASC"))
simple("dedup_last", "events", lambda e: rank.dedup(e.select("user_id", "event_id", "ts", "value"), ["user_id"], "ts", "event_id", "last"), _DEDUP.format("DESC"))
simple("temporal_sort", "events", lambda e: relational.temporal_sort(e.select("event_id", "ts"), "ts", "event_id"), "SELECT event_id, ts FROM events ORDER BY ts, event_id")

# Joins.

# Whole tables: the condition in ON leaves rows of both sides without a match.
for _how, _sql in [("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")]:

    def _whole(spark, sf_dir, how=_how):
        return joins.join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"), how, c("o_totalprice") > 250000).select("o_orderkey", "c_custkey")

    query(f"join_{_how}_whole", f"SELECT o_orderkey, c_custkey FROM orders {_sql} customer ON o_custkey = c_custkey AND o_totalprice > 250000")(_whole)

for _how, _sql in [("left_semi", "EXISTS"), ("left_anti", "NOT EXISTS")]:

    def _half(spark, sf_dir, how=_how):
        return joins.join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), c("c_custkey") == c("o_custkey"), how, c("o_totalprice") > 250000).select("c_custkey")

    query(f"join_{_how[5:]}", f"SELECT c_custkey FROM customer WHERE {_sql} (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")(_half)


@query("join_residual", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice * 0.3")
def _residual(spark, sf_dir):
    return joins.join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), c("o_orderkey") == c("l_orderkey"), "left", c("l_extendedprice") > c("o_totalprice") * 0.3).select("o_orderkey", "l_linenumber")


@query("multiway_join", "SELECT n_name, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def _multiway(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), c("l_orderkey") == c("o_orderkey")).join(t("customer"), c("o_custkey") == c("c_custkey")).join(t("nation"), c("c_nationkey") == c("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


_L = "(SELECT event_id AS a, user_id AS ua, ts AS ta FROM events WHERE event_type = 'click')"
_R = "(SELECT event_id AS b, user_id AS ub, ts AS tb FROM events WHERE event_type = 'purchase')"


def _sides(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda kind, i, u, t: e.where(c("event_type") == kind).select(c("event_id").alias(i), c("user_id").alias(u), c("ts").alias(t))
    return side("click", "a", "ua", "ta"), side("purchase", "b", "ub", "tb")


for _how, _sql in [("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")]:

    def _interval(spark, sf_dir, how=_how):
        left, right = _sides(spark, sf_dir)
        return joins.interval_join(left, right, left["ua"] == right["ub"], left["ta"], right["tb"], "-6 HOURS", "2 HOURS", how).select("a", "b")

    query("interval_join" + ("" if _how == "inner" else f"_{_how}"), f"SELECT a, b FROM {_L} {_sql} {_R} ON ua = ub AND ta BETWEEN tb - INTERVAL 6 HOUR AND tb + INTERVAL 2 HOUR")(_interval)

    def _window(spark, sf_dir, how=_how):
        left, right = _sides(spark, sf_dir)
        return joins.window_join(windows.tumble(left, "ta", "6 hours"), windows.tumble(right, "tb", "6 hours"), [("ua", "ub")], how).select("a", "b")

    query("window_join" + ("" if _how == "inner" else f"_{_how}"), f"SELECT a, b FROM {_L} {_sql} {_R} ON ua = ub AND time_bucket(INTERVAL '6 hours', ta) = time_bucket(INTERVAL '6 hours', tb)")(_window)

for _how, _sql in [("inner", "ASOF JOIN"), ("left", "ASOF LEFT JOIN")]:

    def _temporal(spark, sf_dir, how=_how):
        left, right = _sides(spark, sf_dir)
        return joins.temporal_join(left, right, ("ua", "ub"), "ta", "tb", {"b": "b"}, how, seq="b").select("a", "b")

    query("temporal_join" + ("" if _how == "inner" else f"_{_how}"), f"SELECT a, b FROM {_L} {_sql} (SELECT max(b) AS b, ub, tb FROM {_R} GROUP BY ub, tb) ON ua = ub AND ta >= tb")(_temporal)


@query("lookup_join", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 100")
def _lookup(spark, sf_dir):
    dim = table(spark, sf_dir, "customer").where("c_acctbal > 100").select("c_custkey", "c_name")
    return joins.lookup_join(table(spark, sf_dir, "orders"), dim, c("o_custkey") == c("c_custkey"), "left").select("o_orderkey", "c_name")


def _answer(key):
    return [{"answer": f"k{key}"}] if key % 2 else []


@query("lookup_join_callable", "SELECT event_id, CASE WHEN user_id % 2 = 1 THEN 'k' || user_id END AS answer FROM events")
def _lookup_callable(spark, sf_dir):
    return joins.lookup_join(table(spark, sf_dir, "events").select("event_id", "user_id"), _answer, "user_id", "left", schema="answer string", workers=4).select("event_id", "answer")


# Unnest.


def _lists(t):
    lines = t.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("xs"), F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("rows"))
    empty = c("l_orderkey") % 5 == 0
    return lines.select("l_orderkey", F.when(~empty, c("xs")).alias("xs"), F.when(~empty, c("rows")).alias("rows"), F.create_map(F.lit("n"), F.size("xs"), F.lit("k"), (c("l_orderkey") % 3).cast("int")).alias("m"))


simple("unnest_array", "lineitem", lambda t: relational.unnest(_lists(t), "xs", names=["x"]).select("l_orderkey", "x"), "SELECT l_orderkey, l_linenumber AS x FROM lineitem WHERE l_orderkey % 5 <> 0")
simple("unnest_left", "lineitem", lambda t: relational.unnest(_lists(t), "xs", left=True, names=["x"]).select("l_orderkey", "x"), "SELECT l_orderkey, l_linenumber AS x FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT DISTINCT l_orderkey, NULL FROM lineitem WHERE l_orderkey % 5 = 0")
simple("unnest_ordinality", "lineitem", lambda t: relational.unnest(_lists(t), "rows", ordinality="ord").select("l_orderkey", "l_linenumber", "l_returnflag", "ord"),
       "SELECT l_orderkey, l_linenumber, l_returnflag, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag))::INTEGER AS ord FROM lineitem WHERE l_orderkey % 5 <> 0")
simple("unnest_filter", "lineitem", lambda t: relational.unnest(_lists(t), "rows", where=lambda e: e["l_returnflag"] == "R").select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_returnflag = 'R'")
simple("unnest_map", "lineitem", lambda t: relational.unnest(_lists(t), "m").select("l_orderkey", "key", "value"),
       "SELECT l_orderkey, 'n' AS key, COUNT(*)::INTEGER AS value FROM lineitem GROUP BY l_orderkey UNION ALL SELECT DISTINCT l_orderkey, 'k', (l_orderkey % 3)::INTEGER FROM lineitem")
simple("unnest_multiset", "lineitem", lambda t: relational.unnest(_lists(t), "m", multiset=True, names=["e"]).select("l_orderkey", "e"),
       "SELECT l_orderkey, unnest(list_concat(list_transform(range(n), lambda i: 'n'), list_transform(range(l_orderkey % 3), lambda i: 'k'))) AS e FROM (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY ALL)")

# Changelogs.


def _log(e):
    kind = F.when(c("value") < 20, "-D").when(c("value") < 30, "-U").when(c("value") < 60, "+U").otherwise("+I")
    return e.select((c("user_id") % 50).alias("k"), c("event_type"), kind.alias("row_kind"), c("event_id"))


_LOG = "(SELECT user_id % 50 AS k, event_type, CASE WHEN value < 20 THEN '-D' WHEN value < 30 THEN '-U' WHEN value < 60 THEN '+U' ELSE '+I' END AS row_kind, event_id FROM events)"
simple("changelog_collapse", "events", lambda e: changelog.collapse(_log(e).drop("event_id")),
       f"SELECT k, event_type FROM (SELECT k, event_type, unnest(range(SUM(CASE WHEN row_kind IN ('-U', '-D') THEN -1 ELSE 1 END)::BIGINT)) FROM {_LOG} GROUP BY k, event_type)")
simple("changelog_normalize", "events", lambda e: changelog.normalize(_log(e), ["k"], "event_id"),
       f"SELECT k, event_type, event_id FROM (SELECT * FROM {_LOG} WHERE row_kind <> '-U' QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1) WHERE row_kind <> '-D'")

# Formats: rows written as messages and read back are the rows.

_EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
_ALL = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


def _events(e):
    return e.select("event_id", "ts", "user_id", "event_type", "value", "props")


for _name in ("json", "csv", "avro"):
    simple(f"format_{_name}", "events", lambda e, f=_name: formats.decode(formats.encode(_events(e), f), f, _EVENT), _ALL if _name != "avro" else _ALL.replace(" ts,", " date_trunc('milliseconds', ts) AS ts,"))
simple("format_raw", "events", lambda e: formats.decode_raw(e.select("event_id", c("event_type").cast("binary").alias("value")), "event_type"), "SELECT event_id, event_type FROM events")
simple("format_json_lenient", "events", lambda e: formats.decode_json(e.select("event_id", F.concat(F.lit('[{"n": " '), "user_id", F.lit('", "v": "x"}, {"n": "y"}]')).cast("binary").alias("value")), "n bigint, v string", ignore_parse_errors=True),
       "SELECT event_id, user_id AS n, 'x' AS v FROM events UNION ALL SELECT event_id, NULL, NULL FROM events")


def _kinds(e):
    kind = F.when(c("event_id") % 3 == 0, "-D").otherwise("+I")
    return e.select(kind.alias("row_kind"), c("event_id").alias("id"), c("event_type").alias("name"), c("value").alias("score"))


for _name in formats.CDC:
    simple(f"cdc_{_name}", "events", lambda e, d=_name: formats.decode_cdc(formats.encode_cdc(_kinds(e), d), "id bigint, name string, score double", d),
           "SELECT CASE WHEN event_id % 3 = 0 THEN '-D' ELSE '+I' END AS row_kind, event_id AS id, event_type AS name, value AS score FROM events")


def _updates(e):
    row = lambda v: F.struct(c("event_id").alias("id"), c("event_type").alias("name"), v.alias("score"))
    return e.select(F.to_json(F.struct(row(c("value")).alias("before"), row(c("value") + 1).alias("after"), F.lit("u").alias("op"))).cast("binary").alias("value"))


simple("cdc_update_pairs", "events", lambda e: formats.decode_cdc(_updates(e), "id bigint, name string, score double", "debezium"),
       "SELECT '-U' AS row_kind, event_id AS id, event_type AS name, value AS score FROM events UNION ALL SELECT '+U', event_id, event_type, value + 1 FROM events")
simple("changelog_difference_whole", "events", lambda e: changelog.difference(e.select("event_id", "value"), e.select("event_id", (c("value") + (c("event_id") % 2)).alias("value")), ["event_id"]),
       """WITH b AS (SELECT event_id, value + event_id % 2 AS value FROM events)
          SELECT '-U' AS row_kind, a.event_id, a.value FROM events a JOIN b USING (event_id) WHERE a.value <> b.value
          UNION ALL SELECT '+U', b.event_id, b.value FROM b JOIN events a USING (event_id) WHERE a.value <> b.value""")
