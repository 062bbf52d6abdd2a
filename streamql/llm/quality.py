"""Quality rules: base counts of a text, and boosted trees over its statistics.

The trees are fitted on a bounded sample of labelled documents (at most MAX_LABELS
rows, one a doc_id; statistics only, a few numbers a row) with monotonic constraints: more
symbols, repeated words or duplicate lines never raise a document's chances. They are then
flattened into node arrays and score whole batches at once. Each text is read as a
whole, in one pass, without a shuffle: a document is decided where it lies.

Defined results. Null text: no words, all counts 0, base_failed. Repeated rows are
judged each for itself. Of labels that repeat a doc_id the mean counts, good from a half
on; of documents that repeat one the text with the smallest hash is learnt from. Without
labels of both kinds the verdict is the base rules' alone. Empty table: empty result.
Extra columns are ignored by assess() and carried along by keep().
"""

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_LABELS = 20_000
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
PUNCTUATION = b".,;:!?"
NGRAM = 5

#: name -> -1 where a larger value may only lower the score, 0 where free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "repeat_share": -1, "dup_line_share": -1, "upper_share": 0,
    "punctuation_share": 0, "exclaim_share": -1, "digit_share": 0, "distinct_share": 0, "words_per_line": 0, "non_ascii_share": 0,
}


def repeated_words(words: list[bytes], n: int = NGRAM) -> tuple[int, int]:
    """Words inside n-word windows that occur twice or more, and distinct words. Exact: windows are ranked, not hashed."""
    first: dict[bytes, int] = {}
    ids = np.array([first.setdefault(w, len(first)) for w in words], dtype=np.int64)
    count = len(ids) - n + 1
    if count < 2 or len(first) == len(ids):
        return 0, len(first)
    rank, width = ids, 1
    while width < n:  # ranks of `width` words become ranks of `width + step` words
        step = min(width, n - width)
        pair = rank[: len(ids) - width - step + 1] * len(ids) + rank[step : step + len(ids) - width - step + 1] if step < width else rank[: len(ids) - 2 * width + 1] * len(ids) + rank[width:]
        rank, width = np.unique(pair, return_inverse=True)[1], width + step
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.subtract.at(edge, at + n, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), len(first)


def statistics(text: bytes) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the values of FEATURES."""
    words = text.split()
    raw = np.frombuffer(text.translate(None, SPACE), dtype=np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeated, distinct = repeated_words(words)
    per = lambda some: (len(text) - len(text.translate(None, some))) / max(1, chars)
    n = max(1, len(words))
    values = [np.log1p(len(words)), chars / n, symbols / max(1, chars), repeated / n, dup / max(1, len(lines)), per(UPPER), per(PUNCTUATION), per(b"!"), per(b"0123456789"), distinct / n, len(words) / max(1, len(lines)), float((raw >= 0xC0).sum()) / max(1, chars)]
    return (len(words), chars, symbols, dup, repeated), values


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


@dataclasses.dataclass
class Trees:
    """A boosted ensemble as node arrays; a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float
    threshold: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of being good, for all rows at once: all trees step down together."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, signs, trees=40, depth=3, rate=0.3, bins=64, ridge=1.0, least=5.0) -> Trees:
    """Boosted trees for log loss, by histograms. signs: +1 never falling, -1 never rising, 0 free, per feature."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    cells = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    nodes: list[list] = []  # feature, cut, left, right, value
    roots, margin = [], np.full(len(y), start)

    def grow(rows, g, h, level, low, high):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        me = len(nodes)
        nodes.append([0, np.inf, me, me, rate * float(np.clip(-total_g / (total_h + ridge), low, high))])
        best = (1e-6, None)
        for f in range(x.shape[1]) if level < depth and len(rows) >= 2 else ():
            gs = np.cumsum(np.bincount(cells[rows, f], g[rows], len(cuts[f]) + 1))[:-1]
            hs = np.cumsum(np.bincount(cells[rows, f], h[rows], len(cuts[f]) + 1))[:-1]
            wl, wr = np.clip(-gs / (hs + ridge), low, high), np.clip(-(total_g - gs) / (total_h - hs + ridge), low, high)
            loss = lambda w, gg, hh: gg * w + 0.5 * (hh + ridge) * w * w
            w0 = np.clip(-total_g / (total_h + ridge), low, high)
            gain = loss(w0, total_g, total_h) - loss(wl, gs, hs) - loss(wr, total_g - gs, total_h - hs)
            gain[(hs < least * 0.05) | (total_h - hs < least * 0.05) | (signs[f] * (wr - wl) < 0)] = -1
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (gain[k], (f, k, wl[k], wr[k]))
        if best[1] is None:
            margin[rows] += nodes[me][4]
            return me
        f, k, wl, wr = best[1]
        mid = (wl + wr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[signs[f]]
        goes = cells[rows, f] <= k
        nodes[me][:2] = [f, cuts[f][k]]
        nodes[me][2] = grow(rows[goes], g, h, level + 1, *bounds[0])
        nodes[me][3] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    f, c, a, b, v = zip(*nodes)
    return Trees(np.array(f), np.array(c), np.array(a), np.array(b), np.array(v), np.array(roots), depth, start)


def _stats_of(batch: pa.RecordBatch):
    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
    both = [statistics(t or b"") for t in texts]
    counts = np.array([b[0] for b in both], dtype=np.int64).reshape(-1, 5)
    return counts, np.array([b[1] for b in both]).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, **params) -> Trees | None:
    """Fit the trees on at most max_labels labelled documents, those with the smallest hashes of doc_id; one row a doc_id."""
    good = labels.where(labels["doc_id"].isNotNull() & labels["quality"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("_id"))
    good = good.agg((F.avg(labels["quality"].cast("int")) >= 0.5).cast("int").alias("quality"))
    sample = good.orderBy(F.xxhash64("_id"), "_id").limit(max_labels)  # its bound makes it safe to broadcast
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "quality", F.xxhash64("text").alias("h"), "text")

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(list(_stats_of(b)[1]), pa.list_(pa.float64()))], names=["doc_id", "quality", "h", "x"])

    found = common.mapped(texts, rows, "doc_id long, quality int, h long, x array<double>").groupBy("doc_id").agg(F.min(F.struct("h", "quality", "x")).alias("one"))
    got = found.select("doc_id", "one.quality", "one.x").orderBy("doc_id").toArrow()
    y = got.column("quality").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.array(got.column("x").to_pylist())
    model = fit(x, y, list(FEATURES.values()), **params)
    # Clean documents come first: the cut lies below all but one in a thousand of the good ones.
    model.threshold = float(min(0.0, np.quantile(model.margins(x)[y > 0], 0.001)))
    return model


def _judge(batch, model):
    counts, x = _stats_of(batch)
    failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
    margin = model.margins(x) if model and len(x) else np.zeros(len(x))
    return counts, failed, margin, ~failed & (margin >= (model.threshold if model else 0))


def assess(docs: DataFrame, model: Trees | None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b in batches:
            counts, failed, margin, kept = _judge(b, shared.value)
            score = 1 / (1 + np.exp(-margin))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(score)], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return common.mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), rows, kinds)


def keep(docs: DataFrame, model: Trees | None) -> DataFrame:
    """The documents that pass, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b in batches:
            yield b.filter(pa.array(_judge(b, shared.value)[3]))

    return common.mapped(docs, rows, docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assess(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
