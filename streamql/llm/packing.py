"""Vector best-fit packing of token sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of
squared piece lengths). Pieces are taken longest first; a piece goes to the open
sequence that fits it in every dimension and is best by a weighted score: the least
residual norm, or the largest dot product of demand and residual.

All demands of a piece follow from its length, so pieces of one length can stand for
each other. The packing is therefore solved once, on the driver, over the histogram of
lengths (at most `tokens` rows, whatever the corpus), with runs of equal sequences
handled together. The solution is a list of runs: pieces of length L with ranks r to
r + m lie in sequences b to b + m at offset o. Pieces get their rank within their
length by salted row numbers, so a hot length is spread over many tasks.

By default no sequence of `tokens` tokens can exceed the other two capacities, and their weights
only break ties: that gives the fewest sequences, which op1 asks for. The last stage of
corpus_pipeline.py sets a limit of documents and weights that count.

Defined results. The string of a special token in a text is that token. Null or empty text: one piece that holds only the end token. Longer
documents are cut from the end, so only piece 0 may be shorter. Rows that repeat a
doc_id are packed each. Empty table: empty result. Extra columns are ignored.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .encoding import encoder, read_spec

TOKENS = 1024
END_ID = 2
#: Weights of the residuals of tokens, documents and attention cost: tokens lead, the others break near ties.
WEIGHTS = (1.0, 1e-9, 1e-9)
SALT_ROWS = 1000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def pieces(docs: DataFrame, tokens: int = TOKENS, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Token pieces of every document: (doc_id, piece, start, length, ids_crc32, salt)."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(batches):
        enc, n = encoder(spec.value), 0
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.encode(text or "", special=True) + end
                count = len(ids) // 4
                cut = [0, *range(count % tokens or tokens, count + 1, tokens)]
                for i, (a, e) in enumerate(zip(cut, cut[1:])):
                    n += 1
                    crc = zlib.crc32(ids[4 * a : 4 * e])
                    out.append((doc, i, a, e - a, crc, (crc ^ n * 2654435761) & 0x7FFFFFFF))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return common.mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), rows, PIECES)


def solve(histogram: dict[int, int], tokens: int, documents: int, cost: int, weights=WEIGHTS, rule: str = "residual_norm"):
    """Runs (length, first rank, number, first sequence, offset) that pack all pieces; number of sequences."""
    full = np.array([tokens, documents, cost], dtype=np.int64)
    scale, w = full.astype(float), np.array(weights)
    residual = np.zeros((64, 3), dtype=np.int64)  # a class: sequences with the same residual capacities
    held: list[list[tuple[int, int]]] = []  # its runs of sequences (first, number)
    index: dict[tuple, int] = {}
    runs, opened = [], 0

    def put(left, first, number):
        nonlocal residual
        key = tuple(int(x) for x in left)
        if key not in index:
            index[key] = len(held)
            held.append([])
            if len(held) > len(residual):
                residual = np.concatenate((residual, np.zeros_like(residual)))
            residual[len(held) - 1] = left
        held[index[key]].append((first, number))

    live = lambda: np.fromiter((bool(h) for h in held), bool, len(held))
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length * length], dtype=np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        rank, left = 0, histogram[length]
        while left:
            r = residual[: len(held)]
            fits = np.flatnonzero((r >= need).all(axis=1) & live())
            if not len(fits):
                each = int((full // need).min())
                for k, number in ((each, left // each), (left % each, 1 if left % each else 0)):
                    if number:
                        runs += [(length, rank + i * number, number, opened, i * length) for i in range(k)]
                        put(full - k * need, opened, number)
                        opened, rank, left = opened + number, rank + k * number, left - k * number
                continue
            if rule == "residual_norm":
                best = fits[np.argmin((w * ((r[fits] - need) / scale) ** 2).sum(axis=1))]
            else:
                best = fits[np.argmax((w * (need / scale) * (r[fits] / scale)).sum(axis=1))]
            first, number = held[best].pop()
            m = min(number, left)
            runs.append((length, rank, m, first, int(tokens - residual[best][0])))
            if m < number:
                held[best].append((first + m, number - m))
            put(residual[best] - need, first, m)
            rank, left = rank + m, left - m
    return np.array(runs, dtype=np.int64).reshape(-1, 5), opened


def pack(found: DataFrame, tokens: int = TOKENS, documents: int | None = None, cost: int | None = None, weights=WEIGHTS, rule: str = "residual_norm") -> DataFrame:
    """Pieces with sequence_id and offset. found: a stored pieces() table.

    By default a sequence may hold as many documents and as much attention as its tokens allow.
    """
    spark = found.sparkSession
    histogram = {int(r.length): int(r.n) for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = solve(histogram, tokens, documents or tokens, cost or tokens * tokens, weights, rule)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = spark.sparkContext.broadcast((runs[:, 0] << 44 | runs[:, 1], runs))
    salts = max(1, -(-max(histogram.values(), default=1) // SALT_ROWS))
    salted = found.withColumn("part", F.pmod(F.col("salt"), F.lit(salts)))
    group = Window.partitionBy("length", "part")
    counts = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("rank", F.row_number().over(group.orderBy("salt", "doc_id", "piece")) - 1).join(counts, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))

    def rows(batches):
        keys, table = shared.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            run = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1] if b.num_rows else np.zeros((0, 5), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return common.mapped(ranked, rows, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, tokens: int = TOKENS, tokenizer: str | None = None, **limits) -> DataFrame:
    return pack(common.stored(pieces(docs, tokens, tokenizer=tokenizer), "pack-pieces"), tokens, **limits)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: where every piece of every document lies."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
