"""Substring dedup by difference-cover anchors.

A window of WINDOW words goes if its words also start a window in a document with a
smaller doc_id. Instead of every window only anchors are compared at first: ANCHOR-word
hashes at positions whose remainder modulo PERIOD lies in COVER, a difference cover: any
two positions can both be moved to cover positions by one shift below PERIOD. As
PERIOD + ANCHOR - 1 = WINDOW, two equal windows hold at least one aligned equal anchor.

1. Anchors of each document meet by hash; those that two documents share survive.
2. Around shared anchors matches are extended: only windows that hold a shared anchor
   at their cover position are hashed whole and meet by hash; a window loses if its group
   has a smaller doc_id.
3. Lost windows come back to their rows and their words are removed.

Words are compared by hash only: a window by 96 bits of two rolling hashes where tasks meet
and by 64 bits mixed from them within a chunk. Unequal windows agree by chance with a
probability of 2^-64 a pair at most.

Hot passages. Before both shuffles a task settles what it can: of an anchor or window
that several of its documents hold, only the smallest document's travels on; the others
are known to be shared, or lost. So a passage in a third of all rows reaches a group
once per chunk of CHUNK bytes of text, not once per document. Equal windows of one row
that overlap, as of a word or a line said over and over, travel as one row. Texts are
shuffled once, and both later steps reuse that exchange.

Rows. Everything found is kept by row: under (doc_id, version). The version is 0, or a
64-bit hash of the text as soon as any doc_id has several texts, and for rows without
doc_id; so neither a repeated nor a null id gathers its rows in one task.

Defined results. Null text: no words, result text "". Fewer than WINDOW words: kept
whole. Rows that share a doc_id, with equal or different texts: neither is smaller, so
neither loses to the other, and each loses only what its own text holds. A null doc_id is
smaller than none and larger than none: its row is kept whole and takes no part. Empty
table: empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW, PERIOD, ANCHOR = 50, 31, 20
#: A perfect difference set modulo 31: each remainder is a difference of two members.
COVER = (1, 5, 11, 24, 25, 27)
CHUNK = 8 << 20
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _WordHash(dict):
    """word -> 64-bit hash; bounded, as a task may see any number of words."""

    def __missing__(self, word):
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class _Hasher:
    """Rolling hashes of all windows of a document's word hashes."""

    def __init__(self):
        self.words = _WordHash()
        self.powers = {}

    def codes(self, text: bytes) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, text.split()), dtype=np.uint64)

    def windows(self, codes: np.ndarray, width: int, base: int) -> np.ndarray:
        n = len(codes)
        if n < width:
            return np.zeros(0, dtype=np.uint64)
        if base not in self.powers or len(self.powers[base][0]) < n + 1:
            self.powers[base] = _powers(max(n + 1, 1 << 15), base)
        up, down = self.powers[base]
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes * up[:n], out=sums[1:])
        h = (sums[width:] - sums[:-width]) * down[: n - width + 1]
        h ^= h >> np.uint64(31)
        return h * np.uint64(0xD6E8FEB86659FD93)


def _texts(batches, *more):
    """Chunks of (doc_id, text bytes, further columns) of about CHUNK bytes."""
    held, size = [], 0
    for b in batches:
        at = b.schema.get_field_index
        texts = b.column(at("text")).cast(pa.binary()).to_pylist()
        for row in zip(b.column(at("doc_id")).to_pylist(), texts, *(b.column(at(m)).to_pylist() for m in more)):
            held.append(row)
            size += len(row[1] or b"")
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _first_of_groups(key, doc):
    """Per row: is its doc the smallest of its key here, and has its key another doc here? And the rows in order of key, doc and place."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.r_[True, k[1:] != k[:-1]]
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    low = d[start]
    high = d[np.r_[start[1:], len(k)] - 1]
    least, shared = np.empty(len(k), bool), np.empty(len(k), bool)
    least[order], shared[order] = d == low[group], (high > low)[group]
    return least, shared, order


ANCHOR_ROW = "h long, doc_id long, version long, pos int, known boolean"


def _ints(lists, kind=np.int64):
    return np.concatenate([np.asarray(x, dtype=kind) for x in lists])


def _anchors(batches):
    """Anchors of the chunk: one row per hash for its smallest document, plus the places already known to be shared."""
    hasher = _Hasher()
    for chunk in _texts(batches, VERSION):
        keys, docs, versions, places = [], [], [], []
        for doc, text, version in chunk:
            if doc is None or text is None:
                continue
            codes = hasher.codes(text)
            if len(codes) < WINDOW:
                continue
            at = np.flatnonzero(np.isin(np.arange(len(codes) - ANCHOR + 1) % PERIOD, COVER))
            keys.append(hasher.windows(codes, ANCHOR, MULTIPLIERS[0])[at])
            docs.append(np.full(len(at), doc, dtype=np.int64))
            versions.append(np.full(len(at), version, dtype=np.int64))
            places.append(at)
        if not keys:
            continue
        key, doc, version, place = np.concatenate(keys), _ints(docs), _ints(versions), _ints(places, np.int32)
        least, shared, _ = _first_of_groups(key, doc)
        # What is known goes under a hash of its place, so that it spreads; the smallest document's also meets the others.
        h = np.concatenate((key[least], _spread(doc, version, place)[shared]))
        both = lambda x: pa.array(np.concatenate((x[least], x[shared])))
        known = np.r_[np.zeros(least.sum(), bool), np.ones(shared.sum(), bool)]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), both(doc), both(version), both(place), pa.array(known)], names=["h", "doc_id", "version", "pos", "known"])


def _runs(*columns):
    """Where runs start, and their lengths, in rows whose last column goes up by one within a run, while the others stay."""
    *same, place = columns
    if not len(place):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.diff(place) != 1
    for x in same:
        new |= x[1:] != x[:-1]
    start = np.flatnonzero(np.r_[True, new])
    return start, np.diff(np.r_[start, len(place)])


def _spread(doc, version, place):
    """A hash of a place, to deal rows that meet no others."""
    h = place.astype(np.uint64) * np.uint64(MULTIPLIERS[1]) ^ doc.astype(np.uint64) * np.uint64(MULTIPLIERS[0]) ^ version.view(np.uint64)
    return h * np.uint64(0xD6E8FEB86659FD93)


#: h: window hash; rest: its other 32 bits above the place; n: if the window is lost, so are the words of that many from the place on; if negative, -n windows from the place on are lost.
WINDOW_ROW = "h long, doc_id long, version long, rest long, n int"


def _shared_windows(batches):
    """Windows around shared anchors: of each window the chunk's smallest document's, plus runs already lost."""
    hasher = _Hasher()
    for chunk in _texts(batches, VERSION, ANCHORS):
        first, second, docs, versions, places = [], [], [], [], []
        for doc, text, version, anchors in chunk:
            codes = hasher.codes(text) if anchors and text is not None else ()
            n = len(codes) - WINDOW + 1
            if n <= 0:
                continue
            edge = np.zeros(n + PERIOD + 1, dtype=np.int32)
            a = np.unique(np.array(anchors, dtype=np.int64))
            np.add.at(edge, np.clip(a - PERIOD + 1, 0, n), 1)
            np.add.at(edge, np.clip(a + 1, 0, n), -1)
            at = np.flatnonzero(np.cumsum(edge[:n]) > 0)
            first.append(hasher.windows(codes, WINDOW, MULTIPLIERS[0])[at])
            second.append(hasher.windows(codes, WINDOW, MULTIPLIERS[1])[at] >> np.uint64(32))
            docs.append(np.full(len(at), doc, dtype=np.int64))
            versions.append(np.full(len(at), version, dtype=np.int64))
            places.append(at)
        if not first:
            continue
        h, g, doc, version, place = np.concatenate(first), np.concatenate(second), _ints(docs), _ints(versions), _ints(places)
        key = h ^ (g * np.uint64(MULTIPLIERS[1]))
        least, _, order = _first_of_groups(key, doc)
        # Rows stand by document and place already. Equal windows of a row that overlap, or follow at once, are one: they lose the same words as all windows in between.
        o = order[least[order]]
        k, d, v, p = key[o], doc[o], version[o], place[o]
        start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (np.diff(p) > WINDOW)])
        at, n = o[start], p[np.r_[start[1:], len(p)] - 1] - p[start] + 1
        gone, lost = _runs(doc[~least], version[~least], place[~least])
        gone = np.flatnonzero(~least)[gone]
        both = lambda x: pa.array(np.concatenate((x[at], x[gone])))
        dealt = np.concatenate((h[at], _spread(doc[gone], version[gone], place[gone]))).view(np.int64)
        rest = np.concatenate(((g[at] << np.uint64(32) | place[at].astype(np.uint64)).view(np.int64), place[gone]))
        yield pa.RecordBatch.from_arrays([pa.array(dealt), both(doc), both(version), pa.array(rest), pa.array(np.concatenate((n, -lost)).astype(np.int32))], names=["h", "doc_id", "version", "rest", "n"])


def _removal(text: bytes | None, lost):
    """Words, and a mask of the words to keep. lost: runs of windows, as place << 32 | length."""
    words = (text or b"").split()
    keep = np.ones(len(words), bool)
    if lost:
        edge = np.zeros(len(words) + 1, dtype=np.int32)
        runs = np.array(lost, dtype=np.int64)
        start = runs >> 32
        np.add.at(edge, start, 1)
        np.add.at(edge, start + (runs & 0xFFFFFFFF) - 1 + WINDOW, -1)
        keep = np.cumsum(edge[:-1]) <= 0
    return words, keep


VERSION, ANCHORS, LOST = "__substring_version", "__substring_anchors", "__substring_lost"
DOC_OF, VERSION_OF = "__substring_doc_of", "__substring_version_of"


def _joined(dealt: DataFrame, found: DataFrame) -> DataFrame:
    """dealt with what was found for each row (by DOC_OF and VERSION_OF), null where nothing was."""
    return dealt.join(found, (dealt["doc_id"] == found[DOC_OF]) & (dealt[VERSION] == found[VERSION_OF]), "left").drop(DOC_OF, VERSION_OF)


def with_lost_windows(dealt: DataFrame) -> DataFrame:
    """dealt and the runs of windows to remove per row (null: none).

    dealt: what _dealt() gave. Its three uses ask for the same rows and columns, so that its
    exchange is made once and reused; hence the left joins, and no filter here.
    """
    rows = common.mapped(dealt, _anchors, ANCHOR_ROW)
    by = Window.partitionBy("h")
    met = rows.withColumn("low", F.min("doc_id").over(by)).withColumn("high", F.max("doc_id").over(by))
    row = [F.col("doc_id").alias(DOC_OF), F.col("version").alias(VERSION_OF)]
    shared = met.where("known or low < high").groupBy(*row).agg(F.collect_list("pos").alias(ANCHORS))
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = common.mapped(_joined(dealt, shared), _shared_windows, WINDOW_ROW).repartition(n, "h").withColumn("g", F.shiftright("rest", 32))
    low = whole.withColumn("low", F.min("doc_id").over(Window.partitionBy("h", "g"))).where("n < 0 or low < doc_id")
    run = F.shiftleft(F.col("rest").bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(F.abs("n").cast("long"))
    lost = low.groupBy(*row).agg(F.collect_list(run).alias(LOST))
    return _joined(dealt, lost)


def _dealt(docs: DataFrame) -> DataFrame:
    """docs with their version, dealt by row to as many partitions as the session shuffles to."""
    spark = docs.sparkSession
    h = F.xxhash64(docs["text"])
    texts = docs.select(docs["doc_id"].alias("doc_id"), h.alias("h")).where("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    several = bool(texts.where("low < high").head(1))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return docs.withColumn(VERSION, h if several else F.when(docs["doc_id"].isNull(), h).otherwise(F.lit(0).cast("long"))).repartition(n, "doc_id", VERSION)


def dedup_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of docs."""

    def rows(batches):
        for chunk in _texts(batches, LOST):
            out = []
            for doc, text, lost in chunk:
                words, keep = _removal(text, lost)
                kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    dealt = _dealt(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]))
    return common.mapped(with_lost_windows(dealt), rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """docs, all columns, with repeated passages cut out of text; n_chars, if there, follows.

    A text that loses nothing stays as it is, white space included; of another the kept
    words are joined by single spaces. A document that loses all its words is left out.
    doc_id is a long.
    """
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def rows(batches):
        for b in batches:
            texts, keep_row = b.column(at).to_pylist(), []
            lost_of = b.column(b.num_columns - 1).to_pylist()
            sizes = b.column(chars).to_pylist() if chars >= 0 else None
            for i, lost in enumerate(lost_of):
                keep_row.append(True)
                if lost:
                    words, keep = _removal(texts[i].encode(), lost)
                    texts[i] = b" ".join([words[j] for j in np.flatnonzero(keep)]).decode()
                    keep_row[i] = bool(keep.any())
                    if sizes:
                        sizes[i] = len(texts[i])
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, cols[at].type)
            if sizes is not None:
                cols[chars] = pa.array(sizes, cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep_row))

    return common.mapped(with_lost_windows(_dealt(docs)), rows, docs.schema)


def op7_substring(spark, sf_dir: str) -> DataFrame:
    """Contract query: words removed from and kept of every document."""
    return dedup_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM win JOIN low USING (h) WHERE low < doc_id),
bad AS (SELECT r, list(j) AS js FROM gone GROUP BY r),
kept AS (SELECT w.doc_id, len(words) AS n_words, CASE WHEN js IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda k: NOT list_contains(js, k)), lambda k: words[k]) END AS kept
    FROM w LEFT JOIN bad USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, (n_words - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept"""
