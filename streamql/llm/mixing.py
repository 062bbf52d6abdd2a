"""Mixing sources to target weights.

Tokens (words) are summed per source, the targets are levelled, each source gets the
repetition rate target / size, and a document is emitted floor(rate) times, plus once more
with probability rate - floor(rate), a Bernoulli draw seeded by hashes.

The draws of a source are coupled, so that small sources, too, end near their targets;
each document's probability is the fraction all the same. Documents fall into size classes (a
32nd apart). Classes of a source, largest first, share out its extra copies by systematic
rounding from a start that is uniform by hash: after n documents floor(start + n x fraction)
copies are dealt. Within its class the documents with the smallest hashes get them. The start
being uniform, a class of n documents gets n x fraction copies in the mean; hashes being
exchangeable, each of its documents is one of them with the probability of the fraction. The
words taken miss the target by about one document, where independent draws miss by the root
of their number.

A document decides for itself, given the largest hash that its class still takes: a table
of sources and classes, found by counting (hashes by their first bits, then only those that share
the bits of the one sought). So texts are not shuffled, and no task holds a source.

Defined results. Null text: size 0. Null source: a source of its own, ordered last. The
hash covers doc_id and text; rows that repeat both share their draw. A source without
words has target 0 and rate 0. Empty table: empty result. Only doc_id, text and source are
read, so extra columns of any name are harmless; mixed() carries all columns of its input.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
CAP = 3.0
SEED = 0
#: Bits of a hash, and those that it is counted by.
BITS, FIRST = 52, 12
#: A table of sources and classes up to this many rows (some 10 MB) is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 100_000


def size_of(text):
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def source_key(source):
    """A join key that is never null: sources get a prefix, null is the empty string."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _hash(text):
    """BITS hash bits of a text, as a long."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def draw(doc_id, text, seed: int = SEED):
    """The hash of a document."""
    own = F.coalesce(doc_id.cast("string"), F.lit(""))
    return _hash(F.concat(F.lit(f"{seed}:"), own, F.lit(":"), F.coalesce(F.md5(text), F.lit(""))))


def size_class(size):
    """Sizes of equal length in bits and equal first six bits."""
    n = F.length(F.bin(size))
    return (n * 64 + F.call_function("shiftright", size, F.greatest(n - 6, F.lit(0)))).cast("int")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """Levelled targets per source, from (source, source_size).

    Sources in code point order take the weights in turn. All share the total by
    weight; a source stops at cap times its size and the rest is shared again. In
    order of cap / weight the capped sources come first, so one running sum finds
    the level. The windows span one row per source, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (turn + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everyone = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level)
    # The first source in this order that its level leaves below its cap has the final level.
    whole = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    final = F.first(F.when(F.col("level") * F.col("w") < F.col("most"), F.col("level")), ignorenulls=True).over(whole)
    out = ranked.withColumn("target", F.coalesce(F.least(F.col("most"), final * F.col("w")), F.col("most")))
    return out.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, key, class, u) per row of docs: the mix's input without its texts."""
    size = size_of(docs["text"])
    out = docs.select(docs["doc_id"], docs["source"], size.alias("size"), source_key(docs["source"]).alias("key"), draw(docs["doc_id"], docs["text"], seed).alias("u"))
    return out.withColumn("class", size_class(F.col("size")))


def plan(rows: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """(key, class, source_size, target, whole, last) from sized(): a document of the class is taken `whole` times, plus once if u <= last."""
    by_source = rows.groupBy("source", "key").agg(F.sum("size").alias("source_size"), F.min("u").alias("least"))
    rates = targets(by_source, weights, cap).withColumn("key", source_key(F.col("source"))).drop("source").join(by_source.select("key", "least"), "key")
    start = _hash(F.concat(F.lit(f"{seed}:start:"), F.col("key"), F.lit(":"), F.col("least").cast("string"))) / F.lit(float(1 << BITS))
    rates = common.stored(rates.select("key", "source_size", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"), start.alias("start")), "mix-rates")
    classes = rows.groupBy("key", "class").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("key").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = lambda n: F.floor(F.col("start") + n.cast("double") * F.col("part"))
    classes = classes.withColumn("after", F.sum("n").over(upto)).join(_small(rates), "key").withColumn("k", dealt(F.col("after")) - dealt(F.col("after") - F.col("n")))
    classes = common.stored(classes.drop("after", "start", "part"), "mix-classes")
    some = _small(classes.where("k > 0 and k < n").select("key", "class", "k"))
    bits = rows.withColumn("first", F.shiftright("u", BITS - FIRST))
    before = Window.partitionBy("key", "class").orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = bits.join(some, ["key", "class"]).groupBy("key", "class", "first", "k").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(before))
    sought = common.stored(counts.where("upto >= k and upto - m < k").select("key", "class", "first", (F.col("k") - F.col("upto") + F.col("m")).alias("r")), "mix-sought")
    nth = F.row_number().over(Window.partitionBy("key", "class").orderBy("u"))
    last = bits.join(_small(sought), ["key", "class", "first"]).withColumn("nth", nth).where("nth = r").select("key", "class", F.col("u").alias("at"))
    ends = F.when(F.col("k") >= F.col("n"), F.lit(1 << BITS)).when(F.col("k") <= 0, F.lit(-1)).otherwise(F.col("at"))
    return common.stored(classes.join(last, ["key", "class"], "left").select("key", "class", "source_size", "target", "whole", ends.cast("long").alias("last")), "mix-plan")


def _copies():
    return (F.col("whole") + (F.col("u") <= F.col("last")).cast("int")).cast("long")


def mix_sizes(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) per document: the mix without its texts."""
    rows = common.stored(sized(docs, seed), "mix-sizes")
    joined = rows.join(_small(plan(rows, weights, cap, seed)), ["key", "class"])
    return joined.select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"))


def mixed(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of docs, all columns, each as often as it is taken."""
    found = plan(common.stored(sized(docs, seed), "mix-sizes"), weights, cap, seed)
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), source_key(docs["source"]).alias("key"), size_class(size_of(docs["text"])).alias("class"), draw(docs["doc_id"], docs["text"], seed).alias("u"))
    taken = row.join(_small(found), ["key", "class"])
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), _copies().cast("int")))).select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: what the mix takes of each document."""
    mix = mix_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = r"""
WITH numbered AS (SELECT *, row_number() OVER () AS r FROM documents),
sized AS (SELECT r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM numbered),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, 3.0::DOUBLE * source_size AS most,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM sizes),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
    FROM weighed WINDOW b AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT source, source_size, coalesce(least(most, first_value(CASE WHEN lev * w < most THEN lev END IGNORE NULLS) OVER a * w), most) AS target FROM levels
    WINDOW a AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM final),
rows AS (SELECT s.doc_id, s.source, s.size, length(bin(s.size)) * 64 + (s.size >> greatest(length(bin(s.size)) - 6, 0)) AS class,
    ('0x' || substr(md5('0:' || coalesce(d.doc_id::VARCHAR, '') || ':' || coalesce(md5(d.text), '')), 1, 13))::BIGINT AS u FROM sized s JOIN numbered d USING (r)),
starts AS (SELECT source, ('0x' || substr(md5('0:start:' || coalesce('=' || source, '') || ':' || min(u)), 1, 13))::BIGINT / 4503599627370496.0 AS start FROM rows GROUP BY source),
classes AS (SELECT source, class, count(*) AS n FROM rows GROUP BY source, class),
upto AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY class DESC) AS after FROM classes),
dealt AS (SELECT c.source, class, r.source_size, r.target, floor(rate) AS whole,
    floor(start + after::DOUBLE * (rate - floor(rate))) - floor(start + (after - n)::DOUBLE * (rate - floor(rate))) AS k
    FROM upto c JOIN rates r ON c.source IS NOT DISTINCT FROM r.source JOIN starts s ON c.source IS NOT DISTINCT FROM s.source),
ranked AS (SELECT *, rank() OVER (PARTITION BY source, class ORDER BY u) AS nth FROM rows)
SELECT t.doc_id, t.size, d.source_size, d.target, ((whole + CASE WHEN nth <= k THEN 1 ELSE 0 END) * t.size)::BIGINT AS taken
FROM ranked t JOIN dealt d ON t.source IS NOT DISTINCT FROM d.source AND t.class = d.class"""
