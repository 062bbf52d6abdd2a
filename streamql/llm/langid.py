"""Language ID: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased; its letters' n-grams (ORDERS code points, word boundaries
included) are hashed into BUCKETS embeddings of DIM numbers. Their average goes through
a linear layer and a softmax. Both layers are trained by stochastic gradient descent in
numpy on a bounded sample: of each language the PER_LANG labelled documents with the
smallest row hashes, fewer where there are many languages, so that they are MAX_SAMPLE at
most in all. Only counts of their MOST most frequent buckets reach the driver (12 KB a
document at most). A part of the sample calibrates: a temperature for the scores, and the
score below which a prediction is rejected.

Every language is learnt. Up to FOLDED of them the layers fold into one table (BUCKETS x
languages) for prediction, so a text costs one gather per n-gram; beyond, the embeddings
are averaged first. Whole texts are read, long ones block by block. One pass, no shuffle.

Defined results. Null text, or one without a letter: "und", score 0, not accepted. If
no labelled document can be learnt from, all are "und". More than MAX_SAMPLE values of
lang are an error, as no sample could hold them all. Rows that repeat are learnt from
once and predicted each. Empty table: empty result.
"""

import dataclasses
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
DIM = 16
PER_LANG = 300
MAX_SAMPLE = 20_000
MOST = 2048
FOLDED = 64
BLOCK = 1 << 18
#: Accepted predictions shall be right at this rate on the calibration part.
PRECISION = 0.99
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str):
    """Blocks of bucket numbers, one per n-gram of the lower-cased text; none if it has no letter."""
    # Surrogates, which no valid text has, would not encode.
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    is_letter = _letters()[codes]
    if not is_letter.any():
        return
    c = np.concatenate(([0], np.where(is_letter, codes, 0), [0])).astype(np.uint32)
    reach = max(ORDERS) - 1
    for a in range(0, len(c), BLOCK):
        part = c[a : a + BLOCK + reach]
        own = min(BLOCK, len(part))  # n-grams that start in this block
        found = []
        for n in ORDERS:
            m = min(own, len(part) - n + 1)
            if m <= 0:
                continue
            ok = np.ones(m, bool)
            h = np.full(m, 0x811C9DC5 + n, dtype=np.uint32)
            for i in range(n):
                x = part[i : i + m]
                if n == 1 or 0 < i < n - 1:
                    ok &= x > 0  # no boundary inside
                h = (h ^ x) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            if n == 2:
                ok = (part[:m] > 0) | (part[1 : m + 1] > 0)
            found.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 16))[ok] & np.uint32(BUCKETS - 1))
        yield np.concatenate(found)


@dataclasses.dataclass
class Model:
    """langs, embeddings (BUCKETS x DIM), weights (DIM x languages), bias, temperature and the least accepted score."""

    langs: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def __post_init__(self):
        self.folded = len(self.langs) <= FOLDED
        self.table = (self.embeddings @ self.weights if self.folded else self.embeddings).astype(np.float32)

    def logits(self, text: str | None):
        total, n = np.zeros(self.table.shape[1]), 0
        for g in grams(text) if text else ():
            total += self.table[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        if not n:
            return None
        mean = total / n
        return (mean if self.folded else mean @ self.weights) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        z = self.logits(text) if self.langs else None
        if z is None:
            return UNKNOWN, 0.0, False
        p = _softmax(z / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] >= self.least)


#: The model of no language.
NOTHING = ([], np.zeros((BUCKETS, DIM)), np.zeros((DIM, 0)), np.zeros(0))


def _softmax(z):
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]], langs: list[str], epochs: int = 8, rate: float = 0.5, seed: int = 1) -> Model:
    """SGD over samples of (language number, buckets, their shares). Every fourth sample calibrates."""
    rng = np.random.default_rng(seed)
    tune, learn = samples[::4], [s for i, s in enumerate(samples) if i % 4]
    if not learn:
        tune, learn = samples, samples
    e = rng.normal(0, 0.1, (BUCKETS, DIM))
    w, b = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    size = np.bincount([y for y, _, _ in learn], minlength=len(langs)).astype(float)
    balance = size.sum() / np.maximum(size, 1) / max(1, np.count_nonzero(size))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(learn)):
            y, f, share = learn[i]
            rows = e[f]
            x = share @ rows
            d = _softmax(x @ w + b)
            d[y] -= 1
            d *= step * min(4.0, balance[y])
            # An average moves by its rows' shares; divided by their squares it moves by the step itself.
            e[f] = rows - (0.2 / (share @ share)) * share[:, None] * (w @ d)[None, :]
            w -= np.outer(x, d)
            b -= 0.1 * d
    model = Model(langs, e, w, b)
    z = np.array([share @ e[f] @ w + b for _, f, share in tune])
    y = np.array([s[0] for s in tune])
    grid = np.geomspace(0.05, 20, 60)
    model.temperature = float(grid[np.argmin([-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid])])
    p = _softmax(z / model.temperature)
    order = np.argsort(-p.max(axis=1))
    right = np.cumsum((p.argmax(axis=1) == y)[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= PRECISION)
    model.least = float(p.max(axis=1)[order[good[-1]]]) if len(good) else 1.0
    return model


def _share_end(share: float) -> int:
    """The hash, a signed long, that this share of all hashes doesn't exceed."""
    return min(2**63 - 1, int(share * 2**64) - 2**63)


def train(docs: DataFrame, per_lang: int = PER_LANG, most: int = MAX_SAMPLE) -> Model:
    """Learn from (doc_id, text, lang) rows whose text and lang are not null: per_lang rows a language, `most` in all."""
    own = docs.select(docs["lang"], F.xxhash64(docs["doc_id"], docs["lang"], docs["text"]).alias("u"), docs["text"]).where("text is not null and lang is not null")
    # Row hashes are dealt evenly, so a count tells below which of them the smallest `each` lie, with room to spare.
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.approx_count_distinct("u").alias("n")).limit(most + 1).collect()}
    langs = sorted(counts)
    if len(langs) > most:
        raise ValueError(f"more than {most} languages: no sample of that size holds them all")
    if not langs:
        return Model(*NOTHING)
    each = max(1, min(per_lang, most // len(langs)))
    below = docs.sparkSession.createDataFrame([(x, _share_end((2 * each + 30) / max(1, n))) for x, n in counts.items()], "_lang string, below long")
    # One row a language, so bounded. Only hashes below the bound are made distinct and ranked; rows that repeat count once.
    few = own.join(F.broadcast(below), F.col("lang") == F.col("_lang")).where("u <= below").select("lang", "u").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("u"))
    ends = few.withColumn("nth", nth).where(F.col("nth") <= each).groupBy("lang").agg(F.max("u").alias("last"))
    number = {x: i for i, x in enumerate(langs)}

    def rows(batches):
        for b in batches:
            out = []
            for u, text, lang in zip(*(b.column(i).to_pylist() for i in range(3))):
                seen = list(grams(text))
                if seen:
                    f, n = np.unique(np.concatenate(seen), return_counts=True)
                    top = np.sort(np.argsort(-n, kind="stable")[:MOST])
                    f, n = f[top], n[top]
                    out.append((u, number[lang], f.astype("<u2").tobytes(), (n / n.sum()).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["u", "y", "f", "share"])

    sample = own.join(F.broadcast(ends.withColumnRenamed("lang", "_lang")), F.col("lang") == F.col("_lang")).where("u <= last").select("u", "text", "lang")
    got = sample.mapInArrow(rows, "u long, y int, f binary, share binary").dropDuplicates(["u", "y"]).orderBy("u", "y").toArrow().to_pylist()
    samples = [(r["y"], np.frombuffer(r["f"], "<u2").astype(np.int64), np.frombuffer(r["share"], "<f4").astype(float)) for r in got]
    return fit(samples, langs) if samples else Model(*NOTHING)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) per row; only text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b in batches:
            out = [shared.value.predict(t) for t in b.column(1).to_pylist()]
            cols = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.float64(), pa.bool_())))], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(rows, "doc_id long, lang_pred string, score double, accepted boolean")


def held_out(doc_id):
    """The documents that the contract query must not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op2_language(spark, sf_dir: str) -> DataFrame:
    """Contract query: the language of every document, learnt from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(docs["doc_id"])))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
