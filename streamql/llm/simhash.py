"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint sums the bits of the XXH64 of a text's word shingles. Equal fingerprints
are merged first, so hot copies weigh one row. The rest are linked by an index: 64 bits
fall into BANDS = radius + 1 bands, and of two fingerprints within the radius at least
one band agrees wholly. Per band, the fingerprints that share it are an upper node of
the index (the shared masked pattern; differences so far: 0). Inside a node they are
sorted by the Gray rank of their bits; runs of LEAF neighbours are leaves, runs of
leaves inner nodes, each with the mask of the bits all its members share and their
pattern. A search goes down with the differences accumulated on a node's mask and
leaves a node, with its whole group, once they exceed the radius.

A node with more than NODE_LIMIT members is dealt out again by bands of the bits that
are still open, until 11 bits are left at most: no node, however hot its pattern, is
ever larger than that, and no link is lost. A node reports a spanning forest of its
links, not all pairs. Components are found by distributed label propagation with
pointer jumping; every round is written to the shared folder, and joins by component are
salted, as a component may hold any part of all rows.

Defined results. Null, empty or wordless text: fingerprint zero, linked like any
other. Fewer words than a shingle: the whole sequence is the one shingle. Rows that
repeat a doc_id are returned each. A null doc_id takes part, its component's id is the
smallest non-null one (null if there is none). Empty table: empty result.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

NODE_LIMIT = 2048
LEAF = 16
LAST_BITS = 11
#: Tasks that the rows of one component are dealt to where components are joined.
SALTS = 16
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLOCK = 1 << 15


def majority(blocks) -> int:
    """The SimHash of blocks of 64-bit hashes: a bit is 1 if set in over half of all; 0 without any."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text, over the XXH64 of its shingles."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest

    def blocks():
        for a in range(0, n, BLOCK):
            part = words[a : a + BLOCK + shingle - 1]
            grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
            yield np.fromiter((digest(g, seed) for g in grams), dtype="<u8")

    return majority(blocks())


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) per row of docs."""

    def rows(batches):
        for b in batches:
            fp = np.array([fingerprint(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return common.mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), rows, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _links(codes: np.ndarray, radius: int):
    """Pairs (i, j), i < j, of Gray-sorted codes within the radius, found by going down the index.

    Yields arrays for blocks of queries, so memory stays bounded.
    """
    levels = []  # from leaves up: (first code of each node, mask of shared bits, start, end)
    starts = np.arange(0, len(codes), LEAF)
    ends = np.minimum(starts + LEAF, len(codes))
    differ = np.bitwise_or.reduceat(codes ^ np.repeat(codes[starts], ends - starts), starts)
    levels.append((codes[starts], ~differ, starts, ends))
    while len(levels[-1][0]) > 1:
        pattern, mask, _, _ = levels[-1]
        s = np.arange(0, len(pattern), LEAF)
        e = np.minimum(s + LEAF, len(pattern))
        lead = np.repeat(pattern[s], e - s)
        open_ = np.bitwise_or.reduceat((pattern ^ lead) | ~mask, s)
        levels.append((pattern[s], ~open_, s, e))
    size = max(1, (1 << 20) // max(1, len(codes)) // 4) * LEAF
    for a in range(0, len(codes), size):
        q = np.arange(a, min(a + size, len(codes)))
        node = np.zeros(len(q), dtype=np.int64)  # all start at the root
        for depth in range(len(levels) - 1, -1, -1):
            pattern, mask, s, e = levels[depth]
            near = np.bitwise_count((codes[q] ^ pattern[node]) & mask[node]) <= radius  # differences accumulated so far
            q, node = q[near], node[near]
            width = (e - s)[node]
            base = np.repeat(s[node] - np.cumsum(width) + width, width)
            q, node = np.repeat(q, width), base + np.arange(width.sum())
            if depth == 0:  # leaves hold codes; each pair is met once
                q, node = q[node > q], node[node > q]
        hit = np.bitwise_count(codes[q] ^ codes[node]) <= radius
        yield q[hit], node[hit]


def _forest(n: int, links) -> np.ndarray:
    """The smallest member that each of n nodes reaches."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(root, jumped := root[root]):
                root = jumped
    return root


def _node_edges(radius: int):
    """Rows (node, fp) sorted by node -> edges (a, b) that span each node's links. A node is held whole; its size is bounded."""

    def work(keys, codes):
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[cut, len(keys)])
        two = cut[size == 2]
        near = np.bitwise_count(codes[two] ^ codes[two + 1]) <= radius
        out = [np.stack([codes[two[near]], codes[two[near] + 1]], axis=1)]
        for s, n in zip(cut[size > 2], size[size > 2]):
            own = codes[s : s + n]
            own = own[np.argsort(gray_rank(own), kind="stable")]
            root = _forest(len(own), _links(own, radius))
            linked = np.flatnonzero(root != np.arange(len(own)))
            out.append(np.stack([own[linked], own[root[linked]]], axis=1))
        edges = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    def rows(batches):
        keys, codes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for b in batches:
            keys = np.concatenate((keys, b.column(0).to_numpy()))
            codes = np.concatenate((codes, b.column(1).to_numpy().view(np.uint64)))
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole:
                yield work(keys[:whole], codes[:whole])
                keys, codes = keys[whole:], codes[whole:]
        if len(keys):
            yield work(keys, codes)

    return rows


def _bands(bits: list[int], parts: int) -> list[list[int]]:
    return [list(b) for b in np.array_split(np.array(bits), min(parts, len(bits)))]


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def links(fps: DataFrame, radius: int = 2, limit: int = NODE_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) whose components are those of all links within the radius."""
    # A node is (id of its band path, shared bits); `path` names the masks so that equal bits of different bands differ.
    dealt = fps.select("fp", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("mask"))
    paths = {0: []}  # path -> bits fixed so far
    small = None
    while paths:
        parts, following = [], {}
        options = F.lit(None).cast("array<struct<path:long,mask:long>>")
        for path, fixed in paths.items():
            made = []
            for band in _bands([b for b in range(63, -1, -1) if b not in fixed], radius + 1):
                key = len(following) + 1
                following[key] = fixed + band
                made.append(F.struct(F.lit(key).cast("long").alias("path"), F.lit(_mask(fixed + band)).cast("long").alias("mask")))
            parts.append((path, F.array(*made)))
        for path, made in parts:
            options = F.when(F.col("path") == path, made).otherwise(options)
        rows = dealt.select("fp", F.explode(options).alias("o")).select("fp", "o.path", "o.mask").withColumn("node", F.xxhash64("path", F.col("fp").bitwiseAND(F.col("mask"))))
        done = {k for k, bits in following.items() if 64 - len(bits) <= LAST_BITS}
        sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        hot = common.stored(sizes.where(F.col("n") > limit), "simhash-hot")
        some = hot.head(1)
        fits = rows.join(hot, "node", "left_anti") if some else rows
        last = rows.where(F.col("path").isin(*done)).join(hot, "node", "left_semi") if some and done else None
        for x in (fits, last):
            if x is not None:
                x = x.select("node", "fp")
                small = x if small is None else small.unionAll(x)
        if not some:
            break
        over = rows.where(~F.col("path").isin(*done)).join(hot, "node", "left_semi") if done else rows.join(hot, "node", "left_semi")
        dealt = common.stored(over.select("fp", "path", "mask"), "simhash-open")
        held = {r.path for r in dealt.select("path").distinct().collect()}  # at most a few hundred band paths
        paths = {k: v for k, v in following.items() if k in held}
    placed = small.repartition("node").sortWithinPartitions("node")
    return common.mapped(placed, _node_edges(radius), "a long, b long").distinct()


def _spread_join(many: DataFrame, key: str, by: str, one: DataFrame, own: str, how: str = "inner") -> DataFrame:
    """many joined to one on many.key = one.own, own being unique in one.

    A key may hold any part of many's rows: they are dealt to SALTS tasks by column `by`,
    and each row of one goes to all of these.
    """
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = one.withColumn("_copy", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return dealt.join(copies, (dealt[key] == copies[own]) & (dealt["_salt"] == copies["_copy"]), how).drop("_salt", "_copy")


def _compressed(hooks: DataFrame) -> DataFrame:
    """(root, to) of a forest, to < root, with every to at the end of its path: pointer jumping. hooks is stored, and deleted."""
    while True:
        onward = hooks.select(F.col("root").alias("at"), F.col("to").alias("then"))
        further = common.stored(_spread_join(hooks, "to", "root", onward, "at", "left").select("root", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")), "simhash-hooks")
        common.dropped(hooks)
        hooks = further
        if not hooks.where("moved").head(1):
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every end of an edge: root is the smallest end that edges lead to.

    Every end hooks onto its smallest neighbour, and the forest of hooks is followed to its
    roots. Then each round takes the smallest root around each end; roots that hear of a
    smaller one hook onto it, and the forest of these hooks, which holds roots only, is
    followed likewise. So a round at least halves the roots that still have neighbours.
    """
    both = common.stored(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "simhash-edges")
    least = common.stored(both.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("to")), "simhash-hooks")
    hooks = _compressed(common.stored(least.where("to < root"), "simhash-hooks"))
    ends = least.select(F.col("root").alias("fp"))
    label = common.stored(ends.join(hooks, ends["fp"] == hooks["root"], "left").select("fp", F.coalesce("to", "fp").alias("root")), "simhash-label")
    common.dropped(least, hooks)
    while True:
        around = label.select(F.col("fp").alias("end"), F.col("root").alias("m"))
        heard = _spread_join(both, "b", "a", around, "end").groupBy(F.col("a").alias("fp")).agg(F.min("m").alias("m"))
        hooks = common.stored(label.join(heard, "fp").groupBy("root").agg(F.min("m").alias("to")).where("to < root"), "simhash-hooks")
        if not hooks.head(1):
            common.dropped(both, hooks)
            return label
        hooks = _compressed(hooks)
        to = hooks.select(F.col("root").alias("was"), "to")
        old, label = label, common.stored(_spread_join(label, "root", "fp", to, "was", "left").select("fp", F.coalesce("to", "root").alias("root")), "simhash-label")
        common.dropped(old, hooks)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs."""
    own = common.stored(fingerprints(docs, shingle), "simhash-fp")
    distinct = common.stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius))
    classes = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = classes.join(least, "root").select("fp", "component_id")
    return own.join(ids, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
