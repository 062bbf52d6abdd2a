"""The Nexmark auction queries over a deterministic event stream, each with an oracle.

The stream grows with the data folder: PER_EVENT auction events for each row of its events
table (20,000 at the smallest, 2,000,000 at the bench's scale). Event i: block b = i / 50,
position p = i % 50, time = START plus b seconds plus 10 p milliseconds. p 0 is a person, 1
to 3 are auctions, the rest bids. The same stream is built by Spark and by DuckDB, so every
query is checked row for row.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from streamql.functions import expressions as E
from streamql.operators import joins, rank, windows

PER_EVENT = 20
#: Auction events that one task makes, so that tasks stay alike as the stream grows.
PER_TASK = 1_000_000
#: Early enough in the day that hours of several kinds come up at any scale.
START = "2024-01-01 07:55:00"
STATES = ("OR", "ID", "CA", "WA", "NY", "TX")  # fixed values of the generator
NAMES = ("apple", "google", "facebook", "baidu", "amazon")

c = F.col


def events(spark, sf_dir):
    n = PER_EVENT * spark.read.parquet(f"{sf_dir}/events.parquet").count()
    return stream(spark, n)


def stream(spark, n):
    """The first n events."""
    parts = max(spark.sparkContext.defaultParallelism, -(-n // PER_TASK))
    e = spark.range(0, n, 1, parts).withColumnRenamed("id", "i").withColumn("b", F.expr("i div 50")).withColumn("p", c("i") % 50)
    return e.withColumn("dateTime", F.expr(f"TIMESTAMP_NTZ'{START}' + make_dt_interval(0, 0, 0, cast(b + p * 0.01 as decimal(18,6)))"))


def tasks(e):
    """As many tasks as make the stream, for a step that deals out all of its rows."""
    return e.rdd.getNumPartitions()


def person(e):
    state = F.element_at(F.array(*map(F.lit, STATES)), (c("b") % 6 + 1).cast("int"))
    return e.where("p = 0").select(c("b").alias("id"), F.concat(F.lit("person-"), "b").alias("name"), F.concat(F.lit("city-"), c("b") % 1000).alias("city"), state.alias("state"), "dateTime")


def auction(e):
    i = (c("b") * 3 + c("p") - 1).alias("id")
    return e.where("p BETWEEN 1 AND 3").select(i, F.concat(F.lit("item-"), c("b") * 3 + c("p") - 1).alias("itemName"), F.lit(10).cast("long").alias("initialBid"), "dateTime", (c("dateTime") + F.expr("INTERVAL 20 SECONDS")).alias("expires"), c("b").alias("seller"), (c("b") % 100).alias("category"))


def bid(e):
    a = c("b") * 3 + c("p") % 3
    return e.where("p > 3").select(a.alias("auction"), c("p").alias("bidder"), (c("i") % 1000 + 1).alias("price"), F.concat(F.lit("channel-"), c("p") % 8).alias("channel"), F.concat(F.lit("https://nexmark.test/"), a).alias("url"), "dateTime", "i")


CTE = f"""WITH e AS (SELECT i, i // 50 AS b, i % 50 AS p, TIMESTAMP '{START}' + to_milliseconds(((i // 50) * 1000 + (i % 50) * 10)::DOUBLE) AS dateTime
    FROM (SELECT unnest(range({PER_EVENT} * (SELECT count(*) FROM events))) AS i)),
person AS (SELECT b AS id, 'person-' || b AS name, 'city-' || (b % 1000) AS city, (['OR','ID','CA','WA','NY','TX'])[(b % 6 + 1)::INT] AS state, dateTime FROM e WHERE p = 0),
auction AS (SELECT b * 3 + p - 1 AS id, 'item-' || (b * 3 + p - 1) AS itemName, 10::BIGINT AS initialBid, dateTime, dateTime + INTERVAL 20 SECOND AS expires, b AS seller, b % 100 AS category FROM e WHERE p BETWEEN 1 AND 3),
bid AS (SELECT b * 3 + p % 3 AS auction, p AS bidder, i % 1000 + 1 AS price, 'channel-' || (p % 8) AS channel, 'https://nexmark.test/' || (b * 3 + p % 3) AS url, dateTime, i FROM e WHERE p > 3)
"""

QUERIES, ORACLE_SQL = {}, {}


def query(number, sql):
    def put(f):
        QUERIES[f"nexmark_q{number}"] = lambda spark, sf_dir: f(events(spark, sf_dir))
        ORACLE_SQL[f"nexmark_q{number}"] = CTE + sql
        return f

    return put


WINDOW_10 = "time_bucket(INTERVAL '10 seconds', dateTime)"

query(0, "SELECT auction, bidder, price, dateTime FROM bid")(lambda e: bid(e).select("auction", "bidder", "price", "dateTime"))
query(1, "SELECT auction, bidder, CAST(0.908 * price AS DECIMAL(23,3)) AS price FROM bid")(lambda e: bid(e).select("auction", "bidder", E.decimal_op(F.lit("0.908").cast("decimal(4,3)") * c("price"), 23, 3).alias("price")))
query(2, "SELECT auction, price FROM bid WHERE auction % 123 = 0")(lambda e: bid(e).where(E.modulo(c("auction"), F.lit(123)) == 0).select("auction", "price"))
query(3, "SELECT p.name, p.city, p.state, a.id FROM auction a JOIN person p ON a.seller = p.id WHERE a.category = 10 AND p.state IN ('OR', 'ID', 'CA')")(
    lambda e: auction(e).where("category = 10").select("seller", c("id").alias("a")).join(person(e).where(c("state").isin("OR", "ID", "CA")), c("seller") == c("id")).select("name", "city", "state", c("a").alias("id")))


def _closing(e):
    a = auction(e).select("id", "category", c("dateTime").alias("opens"), "expires", "seller")
    return a.join(bid(e), (c("auction") == c("id")) & c("dateTime").between(c("opens"), c("expires")))


query(4, "SELECT category, CAST(SUM(f) // COUNT(*) AS BIGINT) AS a FROM (SELECT a.id, a.category, MAX(price) AS f FROM auction a JOIN bid b ON a.id = b.auction AND b.dateTime BETWEEN a.dateTime AND a.expires GROUP BY a.id, a.category) GROUP BY category")(
    lambda e: _closing(e).groupBy("id", "category").agg(F.max("price").alias("f")).groupBy("category").agg(F.expr("sum(f) div count(*)").alias("a")))


def _hot(e):
    counts = windows.hop_agg(bid(e), "dateTime", "2 seconds", "10 seconds", ["auction"], {"num": (F.count("*"), "sum")})
    most = F.max("num").over(Window.partitionBy("window_start"))
    return counts.withColumn("most", most).where("num >= most").select("auction", "num", "window_start")


query(5, """, w AS (SELECT auction, unnest([time_bucket(INTERVAL '2 seconds', dateTime) - INTERVAL (2 * k) SECOND FOR k IN range(5)]) AS window_start FROM bid), n AS (SELECT auction, window_start, COUNT(*) AS num FROM w GROUP BY ALL)
    SELECT auction, num, window_start FROM n QUALIFY num = MAX(num) OVER (PARTITION BY window_start)""")(_hot)


def _highest(e):
    b = windows.tumble(bid(e), "dateTime", "10 seconds")
    top = b.groupBy(c("window_end").alias("ends")).agg(F.max("price").alias("most"))
    # Both ends count: a bid at the start of its window is also one of the window before. So windows join by their end, not by price alone.
    here = F.when(c("dateTime") == c("window_start"), F.array("window_end", "window_start")).otherwise(F.array("window_end"))
    near = b.withColumn("ends", F.explode(here)).join(top, "ends").where(c("price") == c("most"))
    return near.select("auction", "price", "bidder", "dateTime")


query(7, f"SELECT b.auction, b.price, b.bidder, b.dateTime FROM bid b JOIN (SELECT MAX(price) AS most, {WINDOW_10} + INTERVAL 10 SECOND AS we FROM bid GROUP BY we) t ON b.price = t.most AND b.dateTime BETWEEN we - INTERVAL 10 SECOND AND we")(_highest)


def _new_sellers(e):
    p = windows.window_agg(windows.tumble(person(e), "dateTime", "10 seconds"), ["id", "name"], [])
    a = windows.window_agg(windows.tumble(auction(e), "dateTime", "10 seconds"), ["seller"], [])
    return joins.window_join(p, a, [("id", "seller")]).select("id", "name", p["window_start"])


query(8, f"SELECT p.id, p.name, p.window_start FROM (SELECT DISTINCT id, name, {WINDOW_10} AS window_start FROM person) p JOIN (SELECT DISTINCT seller, {WINDOW_10} AS window_start FROM auction) a ON p.id = a.seller AND p.window_start = a.window_start")(_new_sellers)
query(9, "SELECT id, bidder, price FROM (SELECT a.id, b.bidder, b.price, b.dateTime, b.i FROM auction a JOIN bid b ON a.id = b.auction AND b.dateTime BETWEEN a.dateTime AND a.expires) QUALIFY row_number() OVER (PARTITION BY id ORDER BY price DESC, dateTime, i) = 1")(
    lambda e: rank.topn(_closing(e), ["id"], [F.desc("price"), F.asc("dateTime"), F.asc("i")], 1).select("id", "bidder", "price"))
query(10, "SELECT auction, price, strftime(dateTime, '%Y-%m-%d') AS d, strftime(dateTime, '%H:%M') AS t FROM bid")(lambda e: bid(e).select("auction", "price", F.date_format("dateTime", "yyyy-MM-dd").alias("d"), F.date_format("dateTime", "HH:mm").alias("t")))
query(11, """, g AS (SELECT bidder, dateTime, CASE WHEN dateTime <= lag(dateTime) OVER w + INTERVAL 900 MILLISECOND THEN 0 ELSE 1 END AS new FROM bid WINDOW w AS (PARTITION BY bidder ORDER BY dateTime)), s AS (SELECT *, SUM(new) OVER (PARTITION BY bidder ORDER BY dateTime ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT bidder, COUNT(*) AS n, MIN(dateTime) AS window_start, MAX(dateTime) + INTERVAL 900 MILLISECOND AS window_end FROM s GROUP BY bidder, sid""")(
    lambda e: windows.session_agg_sliced(bid(e), "dateTime", "900 milliseconds", ["bidder"], {"n": (F.count("*"), "sum")}, "1 HOUR", tasks(e)).drop("window_time"))
query(12, f"SELECT bidder, COUNT(*) AS n, {WINDOW_10} AS window_start FROM bid GROUP BY ALL")(lambda e: windows.window_agg(windows.tumble(bid(e), "dateTime", "10 seconds"), ["bidder"], [F.count("*").alias("n")]).drop("window_end"))


def _named(e):
    dim = e.sparkSession.createDataFrame(list(enumerate(NAMES)), "k long, val string")
    return joins.lookup_join(bid(e).withColumn("m", c("auction") % 10), dim, c("m") == c("k"), "inner").select("auction", "price", "val")


query(13, "SELECT auction, price, val FROM bid JOIN (VALUES (0, 'apple'), (1, 'google'), (2, 'facebook'), (3, 'baidu'), (4, 'amazon')) d(k, val) ON auction % 10 = k")(_named)
query(14, "SELECT auction, CAST(0.908 * price AS DECIMAL(23,3)) AS price, CASE WHEN hour(dateTime) BETWEEN 8 AND 18 THEN 'dayTime' WHEN hour(dateTime) <= 6 OR hour(dateTime) >= 20 THEN 'nightTime' ELSE 'otherTime' END AS kind, (length(url) - length(replace(url, 'e', '')))::BIGINT AS n FROM bid WHERE 0.908 * price > 500")(
    lambda e: bid(e).where(F.lit("0.908").cast("decimal(4,3)") * c("price") > 500).select("auction", E.decimal_op(F.lit("0.908").cast("decimal(4,3)") * c("price"), 23, 3).alias("price"),
        F.when(F.hour("dateTime").between(8, 18), "dayTime").when((F.hour("dateTime") <= 6) | (F.hour("dateTime") >= 20), "nightTime").otherwise("otherTime").alias("kind"), E.count_char(c("url"), "e").alias("n")))
_STATS = "COUNT(*) AS n, COUNT(*) FILTER (WHERE price < 100) AS low, COUNT(*) FILTER (WHERE price >= 100 AND price < 800) AS mid, COUNT(*) FILTER (WHERE price >= 800) AS high, COUNT(DISTINCT bidder) AS bidders, COUNT(DISTINCT bidder) FILTER (WHERE price >= 800) AS high_bidders, COUNT(DISTINCT auction) AS auctions"


def _stats(e, keys):
    when = lambda x, v=1: F.when(x, v)
    low, mid, high = c("price") < 100, (c("price") >= 100) & (c("price") < 800), c("price") >= 800
    b = bid(e).withColumn("day", F.date_format("dateTime", "yyyy-MM-dd"))
    # Auctions grow with the stream: dealt to as many tasks as make it, each of which counts its own. Bidders are few and hot: combined before the shuffle.
    own = b.repartition(tasks(e), *keys, "auction").groupBy(*keys, "auction").agg(F.count("*").alias("n"), F.count(when(low)).alias("low"), F.count(when(mid)).alias("mid"), F.count(when(high)).alias("high"))
    counts = own.groupBy(*keys).agg(*(F.sum(x).alias(x) for x in ("n", "low", "mid", "high")), F.count("auction").alias("auctions"))
    bidders = b.groupBy(*keys).agg(F.count_distinct("bidder").alias("bidders"), F.count_distinct(when(high, c("bidder"))).alias("high_bidders"))
    of = [c(k).alias(f"_{k}") for k in keys]
    same = [c(k).eqNullSafe(c(f"_{k}")) for k in keys]
    return counts.join(bidders.select(*of, "bidders", "high_bidders"), same).select(*keys, "n", "low", "mid", "high", "bidders", "high_bidders", "auctions")


query(15, f"SELECT strftime(dateTime, '%Y-%m-%d') AS day, {_STATS} FROM bid GROUP BY ALL")(lambda e: _stats(e, ["day"]))
query(16, f"SELECT channel, strftime(dateTime, '%Y-%m-%d') AS day, {_STATS} FROM bid GROUP BY ALL")(lambda e: _stats(e, ["channel", "day"]))
query(17, "SELECT auction, COUNT(*) AS n, MIN(price) AS lo, MAX(price) AS hi, CAST(SUM(price) // COUNT(*) AS BIGINT) AS a, SUM(price)::BIGINT AS s FROM bid GROUP BY ALL")(
    lambda e: bid(e).groupBy("auction").agg(F.count("*").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.expr("sum(price) div count(*)").alias("a"), F.sum("price").alias("s")))
query(18, "SELECT auction, bidder, price FROM bid QUALIFY row_number() OVER (PARTITION BY bidder, auction ORDER BY dateTime DESC, i DESC) = 1")(lambda e: rank.dedup(bid(e), ["bidder", "auction"], "dateTime", "i", "last").select("auction", "bidder", "price"))
# Dealt to as many tasks as make the stream. An auction has some 15 bids: to rank in the tasks before would sort all rows twice and spare a third.
query(19, "SELECT auction, bidder, price, row_number() OVER (PARTITION BY auction ORDER BY price DESC, i) AS rn FROM bid QUALIFY rn <= 10")(
    lambda e: rank.topn(bid(e).repartition(tasks(e), "auction"), ["auction"], [F.desc("price"), F.asc("i")], 10, rank_col="rn").select("auction", "bidder", "price", "rn"))
query(20, "SELECT b.auction, b.price, a.itemName, a.category FROM bid b JOIN auction a ON b.auction = a.id WHERE a.category = 10")(lambda e: bid(e).join(auction(e).where("category = 10").select("id", "itemName", "category"), c("auction") == c("id")).select("auction", "price", "itemName", "category"))
query(21, "SELECT auction, CASE WHEN lower(channel) = 'channel-1' THEN '1' WHEN regexp_matches(url, 'test/(\\d*7)$') THEN regexp_extract(url, 'test/(\\d*7)$', 1) END AS id FROM bid")(
    lambda e: bid(e).select("auction", F.when(F.lower("channel") == "channel-1", "1").otherwise(E.regexp_extract(c("url"), r"test/(\d*7)$", 1)).alias("id")))
query(22, "SELECT auction, string_split(url, '/')[3] AS dir1, string_split(url, '/')[4] AS dir2, string_split(url, '/')[5] AS dir3 FROM bid")(lambda e: bid(e).select("auction", *(E.split_index(c("url"), "/", i).alias(f"dir{i - 1}") for i in (2, 3, 4))))
query(23, "SELECT b.price, p.name, a.itemName FROM bid b JOIN person p ON b.bidder = p.id JOIN auction a ON a.seller = p.id")(
    lambda e: bid(e).join(person(e).select(c("id").alias("pid"), "name"), c("bidder") == c("pid")).join(auction(e).select("seller", "itemName"), c("seller") == c("pid")).select("price", "name", "itemName"))
