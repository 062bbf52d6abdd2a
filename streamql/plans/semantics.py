"""Further registered queries: casts, zones, processing time, composite keys, formats with schemas, update-fast Top-N."""

import datetime
import functools
import json

from pyspark.sql import functions as F

from streamql.functions import aggregates as A
from streamql.functions import expressions as E
from streamql.functions import times
from streamql.operators import changelog, joins, rank, windows
from streamql.sources import formats

from .catalog import c, query, simple, table

# Decimals, casts, functions.

simple("decimal_div_mod", "lineitem", lambda t: t.select("l_orderkey", "l_linenumber",
        E.decimal_div(c("l_extendedprice").cast("decimal(12,2)"), (c("l_quantity") + 3).cast("decimal(12,2)"), 27, 13).cast("string").alias("q"),
        E.decimal_mod(c("l_extendedprice").cast("decimal(12,2)"), F.lit("7.35").cast("decimal(4,2)"), 4, 2).alias("m")),
       # The quotient by integers, rounded half up at 13 places.
       """SELECT l_orderkey, l_linenumber, CAST(CAST((2 * (a::HUGEINT * 10000000000000) + b) // (2 * b) AS HUGEINT) // 10000000000000 AS VARCHAR) || '.' || lpad(CAST(CAST((2 * (a::HUGEINT * 10000000000000) + b) // (2 * b) AS HUGEINT) % 10000000000000 AS VARCHAR), 13, '0') AS q,
          CAST((a % 735) / 100.0 AS DECIMAL(4,2)) AS m FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS a, CAST(CAST(l_quantity + 3 AS DECIMAL(12,2)) * 100 AS BIGINT) AS b FROM lineitem)""")
simple("float_div_special", "lineitem", lambda t: t.select("l_orderkey", "l_linenumber", E.divide_float(c("l_extendedprice") * F.when(c("l_linenumber") == 2, -1).when(c("l_linenumber") == 3, 0).otherwise(1), c("l_discount")).alias("x"))
        .select("l_orderkey", "l_linenumber", F.when(F.isnan("x"), "nan").when(c("x") == float("inf"), "inf").when(c("x") == float("-inf"), "-inf").otherwise("number").alias("kind"), F.when(F.abs("x") < float("inf"), F.round("x", 4)).alias("x")),
       """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN 'number' WHEN l_linenumber = 3 THEN 'nan' WHEN l_linenumber = 2 THEN '-inf' ELSE 'inf' END AS kind,
          CASE WHEN l_discount <> 0 THEN ROUND(l_extendedprice * CASE l_linenumber WHEN 2 THEN -1 WHEN 3 THEN 0 ELSE 1 END / l_discount, 4) + 0.0 END AS x FROM lineitem""")
simple("string_casts", "orders", lambda t: t.select("o_orderkey", E.number_to_string(c("o_totalprice").cast("decimal(12,2)")).alias("d"), E.number_to_string(c("o_custkey")).alias("i"),
        E.string_to_number(F.concat(F.lit(" "), c("o_orderkey").cast("string"), F.lit("  ")), "bigint").alias("n"), E.string_to_number(F.lit("-12.50"), "decimal(6,2)").alias("f"), E.float_to_decimal(c("o_totalprice") / 8, 14, 1).alias("r"),
        E.float_to_decimal(c("o_totalprice"), 7, 2).alias("none"), F.expr("CAST(o_orderkey % 2 = 0 AS STRING)").alias("b"), F.lit("true").cast("boolean").alias("t"), c("o_orderstatus").cast("varchar(50)").cast("string").alias("same")),
       """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS d, o_custkey::VARCHAR AS i, o_orderkey AS n, CAST(-12.5 AS DECIMAL(6,2)) AS f, CAST(o_totalprice / 8 AS DECIMAL(14,1)) AS r,
          CASE WHEN round(o_totalprice, 2) < 100000 THEN CAST(o_totalprice AS DECIMAL(12,2))::DECIMAL(7,2) END AS none, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS b, TRUE AS t, o_orderstatus AS same FROM orders""")
_X = "(s_suppkey % 19 - 9) / 10.0"
_FUNCTIONS = {"exp": F.exp, "log10": lambda x: F.log10(x + 1), "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan}
simple("math_fns", "supplier", lambda t: t.withColumn("x", ((c("s_suppkey") % 19 - 9) / 10.0).cast("double")).select("s_suppkey", *(F.round(f(c("x")), 6).alias(n) for n, f in _FUNCTIONS.items())),
       "SELECT s_suppkey, " + ", ".join(f"ROUND({n}({'x + 1' if n == 'log10' else 'x'}), 6) AS {n}" for n in _FUNCTIONS) + f" FROM (SELECT s_suppkey, ({_X})::DOUBLE AS x FROM supplier)")
simple("trim_chr", "part", lambda p: p.select("p_partkey", F.ltrim(F.concat(F.lit("  "), c("p_brand"), F.lit(" "))).alias("l"), F.rtrim(F.concat(F.lit(" "), c("p_brand"), F.lit("  "))).alias("r"), F.chr(c("p_size") + 64).alias("ch")),
       "SELECT p_partkey, p_brand || ' ' AS l, ' ' || p_brand AS r, chr((p_size + 64)::INTEGER) AS ch FROM part")

# Times with local zone.

_ZONE = "America/New_York"
simple("ltz_format_extract", "events", lambda e: e.withColumn("t", E.to_timestamp_ltz(c("event_id") * 7919 * 1000)).select("event_id", times.date_format_ltz(c("t"), "yyyy-MM-dd HH:mm:ss", _ZONE).alias("s"), *(times.extract_ltz(u, c("t"), _ZONE).alias(u) for u in ("year", "month", "day", "hour", "minute", "second"))),
       f"""SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS s, year(t) AS year, month(t) AS month, day(t) AS day, hour(t) AS hour, minute(t) AS minute, second(t) AS second
           FROM (SELECT event_id, timezone('{_ZONE}', make_timestamptz(event_id * 7919 * 1000000)) AS t FROM events)""")
simple("to_timestamp_ltz", "events", lambda e: e.select("event_id", F.unix_micros(E.to_timestamp_ltz(c("event_id") * 1001)).alias("micros")), "SELECT event_id, event_id * 1001000 AS micros FROM events")

# Processing time: the clock of the batch, fixed here so that the oracle knows it.

_CLOCK = datetime.datetime(2024, 5, 6, 7, 8, 9)
_NOW = "TIMESTAMP '2024-05-06 07:08:09'"


def _stamped(e):
    return times.with_proctime(e, "pt", _CLOCK).withColumn("pt", c("pt").cast("timestamp_ntz"))


def _bucket(size):
    return f"time_bucket(INTERVAL '{size}', {_NOW})"


simple("proctime_tumble", "events", lambda e: windows.window_agg(windows.tumble(_stamped(e), "pt", "1 hour"), ["event_type"], [F.count("*").alias("n")]),
       f"SELECT event_type, {_bucket('1 hour')} AS window_start, {_bucket('1 hour')} + INTERVAL 1 HOUR AS window_end, COUNT(*) AS n FROM events GROUP BY ALL")
simple("proctime_hop", "events", lambda e: windows.window_agg(windows.hop(_stamped(e), "pt", "20 minutes", "1 hour"), ["event_type"], [F.count("*").alias("n")]),
       f"SELECT event_type, window_start, window_start + INTERVAL 1 HOUR AS window_end, COUNT(*) AS n FROM (SELECT event_type, unnest([{_bucket('20 minutes')} - INTERVAL (20 * i) MINUTE FOR i IN range(3)]) AS window_start FROM events) GROUP BY ALL")
simple("proctime_cumulate", "events", lambda e: windows.window_agg(windows.cumulate(_stamped(e), "pt", "20 minutes", "1 hour"), ["event_type"], [F.count("*").alias("n")]),
       f"SELECT event_type, {_bucket('1 hour')} AS window_start, window_end, COUNT(*) AS n FROM (SELECT event_type, unnest([{_bucket('1 hour')} + INTERVAL (20 * i) MINUTE FOR i IN [1, 2, 3]]) AS window_end FROM events) WHERE window_end > {_NOW} GROUP BY ALL")
simple("proctime_session", "events", lambda e: windows.session_agg(_stamped(e), "pt", "10 minutes", ["event_type"], [F.count("*").alias("n")]).drop("window_time"),
       f"SELECT event_type, {_NOW} AS window_start, {_NOW} + INTERVAL 10 MINUTE AS window_end, COUNT(*) AS n FROM events GROUP BY ALL")


@query("proctime_interval_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def _proctime_join(spark, sf_dir):
    e = _stamped(table(spark, sf_dir, "events"))
    side = lambda kind, i, u, t: e.where(c("event_type") == kind).select(c("event_id").alias(i), c("user_id").alias(u), c("pt").alias(t))
    left, right = side("click", "a", "ua", "ta"), side("purchase", "b", "ub", "tb")
    return joins.interval_join(left, right, left["ua"] == right["ub"], left["ta"], right["tb"], "-5 MINUTES", "5 MINUTES").select("a", "b")


# Over processing time rows come in order of arrival, which event_id states.
simple("proctime_over_running", "events", lambda e: rank.over(e, ["user_id"], "event_id", {"s": F.sum("event_id"), "n": F.count("*")}, ("rows", None)).select("event_id", "s", "n"),
       "SELECT event_id, (SUM(event_id) OVER w)::BIGINT AS s, COUNT(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
simple("proctime_over_rows", "events", lambda e: rank.over(e, ["user_id"], "event_id", {"hi": F.max("value")}, ("rows", 2)).select("event_id", "hi"),
       "SELECT event_id, MAX(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING) AS hi FROM events")
simple("dedup_proctime", "events", lambda e: rank.dedup(e.select("user_id", "event_id", "value"), ["user_id"], "event_id", "event_id", "last"), "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")

# Composite keys and distinct forms.

simple("group_by_map", "events", lambda e: e.groupBy(F.create_map(c("event_type"), c("user_id") % 3).alias("k")).agg(F.count("*").alias("n")).select(F.map_keys("k")[0].alias("a"), F.map_values("k")[0].alias("b"), "n"),
       "SELECT event_type AS a, user_id % 3 AS b, COUNT(*) AS n FROM events GROUP BY ALL")
simple("group_by_row", "events", lambda e: e.groupBy(F.struct(c("event_type").alias("a"), F.when(c("user_id") % 3 > 0, c("user_id") % 3).alias("b")).alias("k")).agg(F.count("*").alias("n")).select("k.a", "k.b", "n"),
       "SELECT event_type AS a, CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS b, COUNT(*) AS n FROM events GROUP BY ALL")
# A multiset is a map from element to count: equal whatever the order of its elements.
simple("group_by_multiset", "events", lambda e: e.groupBy(F.when(c("event_id") % 2 == 0, F.map_from_arrays(F.array("event_type", F.lit("x")), F.array(F.lit(1), F.lit(2)))).otherwise(F.map_from_arrays(F.array(F.lit("x"), "event_type"), F.array(F.lit(2), F.lit(1)))).alias("k"))
        .agg(F.count("*").alias("n")).select(F.array_join(F.array_sort(F.map_keys("k")), ",").alias("k"), "n"),
       "SELECT array_to_string(list_sort([event_type, 'x']), ',') AS k, COUNT(*) AS n FROM events GROUP BY ALL")
simple("min_max_distinct", "events", lambda e: e.groupBy("event_type").agg(F.expr("min(DISTINCT user_id)").alias("lo"), F.expr("max(DISTINCT user_id)").alias("hi")), "SELECT event_type, MIN(DISTINCT user_id) AS lo, MAX(DISTINCT user_id) AS hi FROM events GROUP BY ALL")
simple("sum_float", "events", lambda e: e.groupBy("event_type").agg(A.sum_float(c("user_id").cast("float")).cast("double").alias("s"), F.avg((c("user_id") % 8).cast("float")).alias("a")).withColumn("a", F.round("a", 6)),
       "SELECT event_type, SUM(user_id)::FLOAT::DOUBLE AS s, ROUND(AVG(user_id % 8), 6) AS a FROM events GROUP BY ALL")
simple("cumulate_sliced", "events", lambda e: windows.cumulate_agg(e, "ts", "1 hour", "4 hours", ["event_type"], {"n": (F.count("*"), "sum"), "hi": (F.max("value"), "max")}),
       """WITH b AS (SELECT *, time_bucket(INTERVAL '4 hours', ts) AS window_start FROM events), w AS (SELECT *, window_start + unnest([1, 2, 3, 4]) * INTERVAL 1 HOUR AS window_end FROM b)
          SELECT event_type, window_start, window_end, COUNT(*) AS n, MAX(value) AS hi FROM w WHERE window_end > ts GROUP BY ALL""")
simple("over_running_sliced", "events", lambda e: rank.over_running(e, ["event_type"], "ts", {"n": (F.count("*"), "sum"), "s": (F.sum("user_id"), "sum"), "hi": (F.max("value"), "max"), "lo": (F.min("value"), "min")}, "1 DAY").select("event_id", "n", "s", "hi", "lo"),
       "SELECT event_id, COUNT(*) OVER w AS n, (SUM(user_id) OVER w)::BIGINT AS s, MAX(value) OVER w AS hi, MIN(value) OVER w AS lo FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE UNBOUNDED PRECEDING)")


@query("window_join_right", "SELECT a, b FROM (SELECT event_id AS a, user_id AS ua, ts AS ta FROM events WHERE event_type = 'click') RIGHT JOIN (SELECT event_id AS b, user_id AS ub, ts AS tb FROM events WHERE event_type = 'purchase') ON ua = ub AND time_bucket(INTERVAL '6 hours', ta) = time_bucket(INTERVAL '6 hours', tb)")
def _window_right(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda kind, i, u, t: e.where(c("event_type") == kind).select(c("event_id").alias(i), c("user_id").alias(u), c("ts").alias(t))
    return joins.window_join(windows.tumble(side("click", "a", "ua", "ta"), "ta", "6 hours"), windows.tumble(side("purchase", "b", "ub", "tb"), "tb", "6 hours"), [("ua", "ub")], "right").select("a", "b")


# Update-fast Top-N: an upsert replaces the row of its key, so the last rows per key are ranked.
simple("topn_update_fast", "events", lambda e: rank.topn(rank.dedup(e.select("event_type", "user_id", "event_id", "value"), ["event_type", "user_id"], "event_id", "event_id", "last"), ["event_type"], [F.desc("value"), F.asc("user_id")], 3, rank_col="rn").select("event_type", "user_id", "value", "rn"),
       "SELECT event_type, user_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, user_id) AS rn FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1) QUALIFY rn <= 3")


def _slow_answer(key):
    return [{"twice": 2 * key, "name": f"k{key}"}] if key % 3 else []


@query("lookup_join_nullable", "SELECT event_id, big, CASE WHEN key % 3 <> 0 THEN 2 * key END AS twice, CASE WHEN key % 3 <> 0 THEN 'k' || key END AS name FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 9007199254740993 + event_id END AS big, CASE WHEN event_id % 5 <> 0 THEN user_id END AS key FROM events)")
def _lookup_nullable(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(c("event_id") % 2 == 0, F.lit(9007199254740993) + c("event_id")).alias("big"), F.when(c("event_id") % 5 != 0, c("user_id")).alias("key"))
    return joins.lookup_join(e, _slow_answer, "key", "left", schema="twice bigint, name string", workers=4).drop("key")


# Formats with schemas of their own.

_ROW = "event_id bigint, user_id bigint, event_type string, value double"
_ROWS = "SELECT event_id, user_id, event_type, value FROM events"


def _known(text, number):
    """A registry that knows one schema."""
    return lambda i: {number: text}[i]


def _plain(e):
    return e.select("event_id", "user_id", "event_type", "value")


simple("format_avro_confluent", "events", lambda e: formats.decode_avro_confluent(formats.encode_avro(_plain(e), schema_id=4711), _ROW, _known(json.dumps(formats.avro_schema(_ROW)), 4711)), _ROWS)


@functools.cache
def _descriptor() -> bytes:
    from google.protobuf import descriptor_pb2 as pb

    file = pb.FileDescriptorProto(name="event.proto", package="streamql", syntax="proto3")
    message = file.message_type.add(name="Event")
    kinds = {"event_id": 3, "user_id": 3, "event_type": 9, "value": 1}
    for i, (name, kind) in enumerate(kinds.items(), 1):
        message.field.add(name=name, number=i, type=kind, label=1)
    return pb.FileDescriptorSet(file=[file]).SerializeToString()


simple("format_protobuf", "events", lambda e: formats.decode_protobuf(formats.encode_protobuf(_plain(e), _descriptor(), "streamql.Event"), _ROW, _descriptor(), "streamql.Event"), _ROWS)

_ENVELOPE = f"op string, before struct<{_ROW.replace(' bigint', ':bigint').replace(' string', ':string').replace(' double', ':double')}>, after struct<{_ROW.replace(' bigint', ':bigint').replace(' string', ':string').replace(' double', ':double')}>"


def _envelopes(e):
    now, was = F.struct("event_id", "user_id", "event_type", "value"), F.struct("event_id", "user_id", "event_type", (c("value") - 1).alias("value"))
    kind = c("event_id") % 4
    return e.select(F.when(kind == 0, "c").when(kind == 1, "r").when(kind == 2, "u").otherwise("d").alias("op"), F.when(kind >= 2, was).alias("before"), F.when(kind <= 2, now).alias("after"))


simple("format_debezium_avro", "events", lambda e: formats.decode_debezium_avro(formats.encode_avro(_envelopes(e), schema_id=9), _ROW, _known(json.dumps(formats.avro_schema(_ENVELOPE)), 9)),
       """SELECT CASE WHEN event_id % 4 < 2 THEN '+I' WHEN event_id % 4 = 2 THEN '+U' ELSE '-D' END AS row_kind, event_id, user_id, event_type, CASE WHEN event_id % 4 = 3 THEN value - 1 ELSE value END AS value FROM events
          UNION ALL SELECT '-U', event_id, user_id, event_type, value - 1 FROM events WHERE event_id % 4 = 2""")


def _partial_updates(e, dialect):
    """Updates that name only what changed: the score of even events, the name of odd ones."""
    new = F.struct(c("event_id").alias("id"), c("event_type").alias("name"), c("value").alias("score"))
    old = F.when(c("event_id") % 2 == 0, F.to_json(F.struct((c("value") + 1).alias("score")))).otherwise(F.to_json(F.struct(F.lit("was").alias("name"))))
    data = F.to_json(new)
    if dialect == "canal":
        data, old = F.concat(F.lit("["), data, F.lit("]")), F.concat(F.lit("["), old, F.lit("]"))
    op = formats.CDC[dialect]["update"][0]
    return e.select(F.concat(F.lit('{"data": '), data, F.lit(', "old": '), old, F.lit(f', "type": "{op}"}}')).cast("binary").alias("value"))


for _name in ("maxwell", "canal"):
    simple(f"cdc_update_{_name}", "events", lambda e, d=_name: formats.decode_cdc(_partial_updates(e, d), "id bigint, name string, score double", d),
           """SELECT '+U' AS row_kind, event_id AS id, event_type AS name, value AS score FROM events
              UNION ALL SELECT '-U', event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'was' END, CASE WHEN event_id % 2 = 0 THEN value + 1 ELSE value END FROM events""")


def _whole_updates(e):
    row = lambda v: F.struct(c("event_id").alias("id"), c("event_type").alias("name"), v.alias("score"))
    return e.select(F.to_json(F.struct(row(c("value")).alias("before"), row(c("value") + 1).alias("after"), F.lit("U").alias("op_type"))).cast("binary").alias("value"))


simple("cdc_update_ogg", "events", lambda e: formats.decode_cdc(_whole_updates(e), "id bigint, name string, score double", "ogg"),
       "SELECT '-U' AS row_kind, event_id AS id, event_type AS name, value AS score FROM events UNION ALL SELECT '+U', event_id, event_type, value + 1 FROM events")


def _with_map(e, bump):
    return e.select("event_id", F.create_map(F.lit("a"), c("user_id"), F.lit("b"), c("event_id") + bump).alias("m"))


# Rows with a map: the same entries in another order are no change.
simple("changelog_difference_map", "events",
       lambda e: changelog.difference(_with_map(e, F.lit(0)), e.select("event_id", F.create_map(F.lit("b"), c("event_id") + c("event_id") % 2, F.lit("a"), c("user_id")).alias("m")), ["event_id"]).select("row_kind", "event_id", c("m")["b"].alias("b")),
       "SELECT '-U' AS row_kind, event_id, event_id AS b FROM events WHERE event_id % 2 = 1 UNION ALL SELECT '+U', event_id, event_id + 1 FROM events WHERE event_id % 2 = 1")
simple("dedup_map_column", "events", lambda e: rank.dedup(e.select("user_id", "event_id", "ts", F.create_map(F.lit("v"), c("value")).alias("m")), ["user_id"], "ts", "event_id", "last").select("user_id", "event_id", c("m")["v"].alias("value")),
       "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
