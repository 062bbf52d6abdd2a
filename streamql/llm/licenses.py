"""License scans: ordered signature rules, in Spark's own functions only.

A text is gated first: case-blind word tests tell whether any rule can match at all. Only
gated texts are normalised to lower case words joined by single spaces. There each keyword
that occurs opens its rules, whose patterns are literals of the plan, compiled once a task; a
rule that matches marks the first and last word of its places. Overlapping places are then
settled in one sweep in order of their first words (the longer, then the stronger rule
first): a place inside the one that stands goes (so of equal places the rule that stands
first in RULES wins), and of places that merely overlap the one with the stronger rule
stands.

It is one scan without a shuffle or a join, so no key can be hot and a lost task is
simply run again. The work grows with the text and the number of its places, as chains of
overlapping places are swept apart from each other.

Defined results. Null or empty text: no word, no place, labels "", score 0. Repeated
rows are scanned each for itself. Extra columns of any name are ignored.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .license_rules import BASE, GATE_WORDS, RULES

#: Words of a license scan: ASCII letters and digits and all non-ASCII characters. Classes list each
#: ASCII character, which Java looks up in a table, while it would try ranges one after the other.
_OTHER = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
NO_WORD, CASED_WORD = f"[{_OTHER}]", f"[^{_OTHER}]+"
#: The one base phrase without a rare word.
GATE_CC = f"(?i)cc{NO_WORD}+by"
#: Places of a chain that are swept at a time.
BLOCK = 256

PLACE = "struct<first:int,ending:int,priority:int,label:string,relevance:double>"


def normalised(text):
    """' word word ... word ' in lower case; a text without words is a single space."""
    return F.regexp_replace(F.concat(F.lit(" "), common.ascii_lower(text), F.lit(" ")), f"{NO_WORD}+", " ")


def _places(priority: int, label: str, pattern: str, relevance: float) -> str:
    """SQL for where a rule matches in text n, null if nowhere: both ends are marked, then found among the words."""
    own = f"'(?<= )({pattern})(?= )'"
    marked = f"slice(split(regexp_replace(n, {own}, '\\u0001$1\\u0002'), ' '), 2, 1073741824)"
    at = lambda test: f"filter(transform(w, (x, i) -> CASE WHEN {test} THEN i END), i -> i IS NOT NULL)"
    starts, ends = at("startswith(x, '\\u0001')"), at("endswith(x, '\\u0002')")
    place = f"named_struct('first', a, 'ending', -b, 'priority', {priority}, 'label', '{label}', 'relevance', double({relevance}))"
    return f"CASE WHEN rlike(n, {own}) THEN transform(array({marked}), w -> zip_with({starts}, {ends}, (a, b) -> {place}))[0] END"


def _all_places(norm: str):
    """The places of all rules in column norm, sorted by first word, then longer and stronger ones first."""
    groups = {}
    for i, (label, keyword, pattern, relevance) in enumerate(RULES):
        groups.setdefault(keyword, []).append(_places(i, label, pattern, relevance))
    opened = (f"CASE WHEN contains(n, '{k}') THEN flatten(filter(array({', '.join(rules)}), r -> r IS NOT NULL)) END" for k, rules in groups.items())
    return F.expr(f"transform(array({norm}), n -> sort_array(flatten(filter(array({', '.join(opened)}), g -> size(g) > 0))))[0]")


def _let(value, body):
    """body(value), with value worked out once: inside a lambda it would be once per element."""
    return F.transform(F.array(value), body)[0]


def _swept(places):
    """The places that stay of a chain. In one sweep each place meets the last one that stands.

    A step copies the state, so it is kept short: BLOCK places are swept at a time.
    """
    none, empty = F.lit(None).cast(PLACE), F.array().cast(f"array<{PLACE}>")

    def state(out, last):
        return F.struct(out.alias("out"), last.alias("last"))

    def step(s, x):
        last = s["last"]
        apart, inside, stronger = x["first"] > -last["ending"], x["ending"] >= last["ending"], x["priority"] < last["priority"]
        pushed, replaced = state(F.concat(s["out"], F.array(last)), x), state(s["out"], x)
        return F.when(last.isNull(), replaced).when(apart, pushed).when(inside | ~stronger, s).otherwise(replaced)

    def block(s, some):
        return _let(F.aggregate(some, state(empty, s["last"]), step), lambda r: state(F.concat(s["out"], r["out"]), r["last"]))

    blocks = F.transform(F.sequence(F.lit(0), F.size(places) - 1, F.lit(BLOCK)), lambda k: F.slice(places, k + 1, F.lit(BLOCK)))
    return F.aggregate(blocks, state(empty, none), block, lambda s: F.concat(s["out"], F.array(s["last"])))


def _settled(found):
    """The places that stay, in order: chains of overlapping places are told apart and swept each.

    The i-th place opens a chain if all i places before it have ended, that is, if the i-th
    smallest last word lies before its first.
    """

    def chains(places, lasts):
        opens = F.filter(F.transform(places, lambda p, i: F.when((i == 0) | (F.get(lasts, i - 1) < p["first"]), i)), lambda i: i.isNotNull())
        return _let(opens, lambda at: F.zip_with(at, F.concat(F.slice(at, 2, 2**30), F.array(F.size(places))), lambda a, z: F.slice(places, a + 1, z - a)))

    def settle(places):
        cut = _let(F.sort_array(F.transform(places, lambda p: -p["ending"])), lambda lasts: chains(places, lasts))
        return F.flatten(F.transform(cut, lambda c: F.when(F.size(c) == 1, c).otherwise(_swept(c))))

    # One type throughout: where only nullability differs, Spark would cast whole states.
    return _let(found.cast(f"array<{PLACE}>"), settle)


def _spaces(text):
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column ``scan``: n_words, n_base, first_word, last_word, base_labels, places, labels, score.

    places holds the settled matches (first and last word, rule priority, label, relevance);
    labels are their labels and the base ones, sorted; score is the largest relevance.
    Each step below is a column of its own, so that nothing costly is evaluated twice.
    """
    held = [c for c in docs.columns if c != "scan"]
    out = docs.select(*(docs[c] for c in held), F.coalesce(docs[text], F.lit("")).alias("_lic_raw"))
    out = out.withColumn("_lic_low", F.lower("_lic_raw"))
    gate = F.contains("_lic_low", F.lit("cc")) & F.rlike("_lic_raw", F.lit(GATE_CC))
    for w in GATE_WORDS:
        gate = F.contains("_lic_low", F.lit(w)) | gate
    out = out.withColumn("_lic_words", F.regexp_count("_lic_raw", F.lit(CASED_WORD)).cast("long")).withColumn("_lic_norm", F.when(gate, normalised(F.col("_lic_raw"))))
    norm, n_words = F.col("_lic_norm"), F.col("_lic_words")
    has = [norm.isNotNull() & F.contains(norm, F.lit(f" {p} ")) for p, _ in BASE]
    count = [F.when(h, F.regexp_count(norm, F.lit(f"(?<= ){p}(?= )"))).otherwise(0) for h, (p, _) in zip(has, BASE)]
    first = [F.when(h, _spaces(F.substring_index(norm, f" {p} ", 1))) for h, (p, _) in zip(has, BASE)]
    last = [F.when(h, n_words - _spaces(F.substring_index(norm, f" {p} ", -1)) - len(p.split())) for h, (p, _) in zip(has, BASE)]
    base = F.array_sort(F.filter(F.array(*(F.when(h, F.lit(label)) for h, (_, label) in zip(has, BASE))), lambda x: x.isNotNull()))
    out = out.select(
        *held, n_words, sum(count[1:], count[0]).cast("long").alias("_lic_n"), F.least(*first).cast("long").alias("_lic_first"), F.greatest(*last).cast("long").alias("_lic_last"),
        base.alias("_lic_base"), F.when(norm.isNotNull(), _all_places("_lic_norm")).alias("_lic_found"),
    )
    out = out.withColumn("_lic_kept", F.coalesce(F.when(F.size("_lic_found") > 0, _settled(F.col("_lic_found"))), F.array().cast(f"array<{PLACE}>")))
    kept = F.col("_lic_kept")
    labels = F.array_sort(F.array_union("_lic_base", F.transform(kept, lambda p: p["label"])))
    score = F.greatest(F.when(F.col("_lic_n") > 0, 0.8).otherwise(0.0), F.coalesce(F.array_max(F.transform(kept, lambda p: p["relevance"])), F.lit(0.0)))
    places = F.transform(kept, lambda p: F.struct(p["first"].alias("first"), (-p["ending"]).alias("last"), p["priority"].alias("priority"), p["label"].alias("label"), p["relevance"].alias("relevance")))
    full = F.struct(
        n_words.alias("n_words"), F.col("_lic_n").alias("n_base"), F.col("_lic_first").alias("first_word"), F.col("_lic_last").alias("last_word"),
        F.col("_lic_base").alias("base_labels"), places.alias("places"), labels.alias("labels"), score.alias("score"),
    )
    # explode() of one element: a filter on the result stays above it instead of being rewritten, step by step, into the scan.
    return out.select(*held, F.explode(F.array(full)).alias("scan"))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """Contract query: the scan of every document, digested."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    s = F.col("scan")
    return scan(docs).select(
        "doc_id", s["n_words"].alias("n_words"), s["n_base"].alias("n_base"), s["first_word"].alias("first_word"), s["last_word"].alias("last_word"),
        F.array_join(s["base_labels"], ",").alias("base_labels"), F.array_join(s["labels"], ",").alias("labels"), s["score"].alias("score"), F.size(s["places"]).alias("n_places"),
    )
