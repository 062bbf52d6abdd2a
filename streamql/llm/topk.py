"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows (component t with weight floor(256 x), zeros left
out). A task takes its candidates in blocks, holds a block as postings (per term: the
candidates that have it and their weights) and, term by term, scatters the weighted
postings of a block of query rows into a dense score array, one row per query. From
the array the k best of a partition are selected; partitions are merged at the end.

Queries are read in chunks, each broadcast to all candidate tasks and answered in a pass of its
own, its result written to the shared folder. A chunk has QUERY_CHUNK rows at most and
CELLS numbers (rows x longest vector, 16 MB); a block of candidates has C_BLOCK rows and CELLS
numbers at most, so one very long vector makes blocks small, not large. Candidates are never
shuffled or paired with a join.

Defined results. A vector that is null or holds a null or non-finite component takes
no part, nor does a row without vec_id. Vectors of different length: missing terms
count 0; an empty vector scores 0. A query's own row is left out by vec_id, so rows
that repeat an id never meet each other, and a repeated query id is answered once,
from its first row in value order. Scores beyond a long end at its limits. Empty table:
empty result. Extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 256
QUERY_CHUNK = 16384
#: Rows of a query block and of a candidate block: their score array stays in cache.
Q_BLOCK, C_BLOCK = 64, 8192
#: Numbers of a chunk of queries, or of a block of candidates, as a dense matrix.
CELLS = 1 << 21
LONG = 2**63 - 1


def integer_rows(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vec array<double> of floor(256 x)) of the rows that take part."""
    v = vectors[embedding].cast("array<double>")
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    # floor in doubles: exact, and no overflow for huge components.
    whole = F.transform(v, lambda x: F.rint(x * SCALE) - F.when(F.rint(x * SCALE) > x * SCALE, 1.0).otherwise(0.0))
    return vectors.where(v.isNotNull() & good & vectors[vec_id].isNotNull()).select(vectors[vec_id].cast("long").alias("vec_id"), whole.alias("vec"))


def _matrix(ids: pa.Array, vecs: pa.ListArray):
    """Rows sorted by id as a dense matrix: int64 where that is exact, else Python ints."""
    ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(vecs.offsets.to_numpy())
    flat = vecs.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    width = int(lengths.max()) if len(lengths) else 0
    dense = np.zeros((len(ids), width))
    dense[np.repeat(np.arange(len(ids)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    big = len(flat) and np.abs(flat).max() >= 2**53
    return ids[order], np.array([[int(x) for x in row] for row in dense[order]], dtype=object).reshape(dense.shape) if big else dense[order].astype(np.int64)


def _number_type(terms: int, q, c):
    """The narrowest type that holds every inner product of q's and c's rows."""
    most = max(1, terms) * max(1, int(abs(q).max(initial=0))) * max(1, int(abs(c).max(initial=0)))
    return np.int32 if most < 2**31 else np.int64 if most < 2**63 else object


def _select(scores, ids, own, k):
    """Per row the k best columns, ties to the smaller id (ids ascend): row numbers and columns."""
    rows, cols = [], []
    for r in range(len(scores)):
        s = scores[r]
        mine = np.searchsorted(ids, [own[r], own[r] + 1]) if own[r] < LONG else np.searchsorted(ids, [own[r], own[r]]) + [0, np.count_nonzero(ids == own[r])]
        keep = np.concatenate((np.arange(mine[0]), np.arange(mine[1], len(ids)))) if mine[1] > mine[0] else None
        t = s if keep is None else s[keep]
        if len(t) > k:
            edge = np.partition(t, len(t) - k)[len(t) - k]
            above = np.flatnonzero(t > edge)
            best = np.concatenate((above, np.flatnonzero(t == edge)[: k - len(above)]))
        else:
            best = np.arange(len(t))
        cols.append(best if keep is None else keep[best])
        rows.append(np.full(len(best), r))
    return np.concatenate(rows), np.concatenate(cols)


def _accumulate(q, c):
    """Inner products of query rows and a candidate block, term at a time."""
    kind = _number_type(min(q.shape[1], c.shape[1]), q, c)
    scores = np.zeros((len(q), len(c)), dtype=kind)
    q, c = q.astype(kind), c.astype(kind)
    for t in range(min(q.shape[1], c.shape[1])):
        has, weights = np.flatnonzero(q[:, t]), c[:, t]
        postings = np.flatnonzero(weights)
        if not len(has) or not len(postings):
            continue
        if len(postings) == len(c) and len(has) == len(q):  # a full list needs no addresses
            scores += q[:, t, None] * weights
        else:
            scores[np.ix_(has, postings)] += q[has, t, None] * weights[postings]
    return np.clip(scores, -LONG - 1, LONG).astype(np.int64) if kind is object else scores


def _searcher(queries, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        q_ids, q = queries.value
        best = None  # query row, id, score of the best so far: at most k per query

        def take(ids, c, best):
            found = []
            for a in range(0, len(q), Q_BLOCK):
                scores = _accumulate(q[a : a + Q_BLOCK], c)
                rows, cols = _select(scores, ids, q_ids[a : a + Q_BLOCK], k)
                found.append((rows + a, ids[cols], scores[rows, cols]))
            rows, got, score = (np.concatenate([x[i] for x in found]) for i in range(3))
            if best is not None:
                rows, got, score = (np.concatenate(x) for x in zip(best, (rows, got, score)))
            score = score.astype(np.int64)
            order = np.lexsort((got, ~score, rows))  # ~ instead of -, which the least long has not
            rows, got, score = rows[order], got[order], score[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            return tuple(x[rank < k] for x in (rows, got, score))

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= C_BLOCK:
                best, held, n = _blocks(held, take, best), [], 0
        if n:
            best = _blocks(held, take, best)
        if best is not None and len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[best[0]]), pa.array(best[1]), pa.array(best[2])], schema=schema)

    return search


def _cuts(widths: np.ndarray) -> list[int]:
    """Ends of blocks of rows: at most C_BLOCK rows and, but for single rows, CELLS numbers as a matrix."""
    ends, rows, widest = [], 0, 0
    for i, w in enumerate(widths.tolist()):
        if rows and (rows >= C_BLOCK or (rows + 1) * max(widest, w) > CELLS):
            ends.append(i)
            rows = widest = 0
        rows, widest = rows + 1, max(widest, w)
    return [*ends, len(widths)]


def _blocks(held, take, best):
    table = pa.Table.from_batches(held).combine_chunks()
    widths = np.concatenate([np.diff(c.offsets.to_numpy()) for c in table.column(1).chunks])
    a = 0
    for z in _cuts(widths):
        part = table.slice(a, z - a).combine_chunks().to_batches()[0]
        vecs = part.column(1)
        ids, c = _matrix(part.column(0), vecs if vecs.offset == 0 else pa.concat_arrays([vecs]))
        best, a = take(ids, c, best), z
    return best


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, chunk: int = QUERY_CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates per query; both sides from integer_rows()."""
    spark = candidates.sparkSession
    first = Window.partitionBy("vec_id").orderBy("vec")
    asked = common.stored(queries.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), "topk-queries")
    rows, widest = asked.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    chunks = max(1, -(-rows // chunk), -(-rows * widest // CELLS))
    merged = None
    for i in range(chunks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == i).orderBy("vec_id").toArrow()
        if not part.num_rows:
            continue
        part = part.combine_chunks().to_batches()[0]
        shared = spark.sparkContext.broadcast(_matrix(part.column(0), part.column(1)))
        found = candidates.mapInArrow(_searcher(shared, k), "query_id long, vec_id long, score long")
        found = common.stored(found, "topk-found") if chunks > 1 else found
        merged = found if merged is None else merged.unionAll(found)
    if merged is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    """Contract query: the five best of every row whose id is divisible by 50, against all rows."""
    rows = integer_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(rows.where(F.col("vec_id") % 50 == 0), rows)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""
