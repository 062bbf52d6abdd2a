"""Near-duplicates by SimHash and by the Jaccard similarity of five-word shingles.

Two texts are linked if the sets of their SHINGLE-word shingles have a Jaccard similarity
of 0.8 or more (9 x overlap >= 4 x sum of sizes, compared exactly), or if the SimHashes
of these sets are linked as in simhash.py. Texts with equal sets are one row from the
start, so copies weigh one row however many there are.

SimHash alone does not reach 0.8: two such sets differ in some 10 of 64 bits. So candidates
come from MinHash bands besides: BANDS keys of ROWS minima each. Sets that share a key form
a node. A node gets the sets of its members and compares them all, and it reports a
spanning forest of the links found, never pairs. A pair at just 0.8 shares no band with
probability (1 - 0.8^4)^24, 3 in a million; at 0.85 it is 9 in a billion.

Bands are taken in rounds (ROUNDS), with components in between: a node is skipped where its
members are one component already, or where all of them met in one node of an earlier
round. So most sets travel once or twice, not once per band.

Hot nodes. A node of more than NODE_SETS sets or NODE_SHINGLES shingles is cut into blocks, and
every two blocks meet in a tile of their own: no task holds more than two blocks and no
pair is left out. The cost of such a node is the square of its number of blocks; it arises only
where thousands of different texts share all minima of a band, that is, are nearly equal.

Hot bands. A key that more than _hot() sets share is looked up by broadcast, not by a shuffle
on the key, and there are at most HOT_KEYS of these at any size of the table, as the bound grows with it.

Defined results. Words are folded as in simhash.py. Fewer words than a shingle: the
whole sequence is the one shingle. Wordless texts are linked with each other only. Every
row is judged by its own text, so a doc_id that repeats with other texts joins nothing.
Rows that repeat are returned each. A null doc_id takes part, but never names a component
that has another (null if it has none). Empty table: empty result. Only doc_id and text
are read.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash, substring

SHINGLE = 5
BANDS, ROWS = 24, 4
#: The bands of each round, as (first, end).
ROUNDS = ((0, 2), (2, 6), (6, BANDS))
#: A node with more sets, or more shingles in all, is cut into blocks.
NODE_SETS, NODE_SHINGLES = 1024, 1 << 21
#: So many keys are broadcast at most (16 bytes each).
BROADCAST = 200_000
#: So many band keys count as hot at most (24 bytes each); fewer sets than HOT_LEAST never make one hot.
HOT_KEYS, HOT_LEAST = 100_000, 256
#: Rows of a batch that are hashed together, and hashes of a block.
BATCH, BLOCK = 256, 2048
#: Odd multipliers, from a rule: each gives one order of all hashes.
ORDERS = np.array([xxhash.xxh64_intdigest(f"order {i}") | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)


class _Words(dict):
    """word -> 64-bit hash; bounded."""

    def __missing__(self, word):
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


class _Shingler:
    def __init__(self):
        self.hasher = substring._Hasher()
        self.hasher.words = _Words()

    def set(self, text: bytes | None) -> np.ndarray:
        """Sorted hashes of the text's shingles."""
        codes = self.hasher.codes((text or b"").translate(simhash.LOWER))
        width = min(SHINGLE, len(codes))
        return np.unique(self.hasher.windows(codes, width, substring.MULTIPLIERS[width < SHINGLE])) if width else codes


def _blocks(own: np.ndarray):
    for a in range(0, len(own), BLOCK):
        yield own[a : a + BLOCK]


def set_id(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 5)


def bands(own: np.ndarray) -> np.ndarray:
    """The keys of a set's bands; they differ by band, too."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for part in _blocks(own):
        h = part[:, None] * ORDERS
        h ^= h >> np.uint64(32)
        np.minimum(least, h.min(axis=0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ least[i::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _signed(x):
    return pa.array(np.array(x, dtype=np.uint64).view(np.int64))


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            yield b.slice(at, BATCH)


KEYS = "doc_id long, h long, sid long, fp long, size int, bands array<long>"


def _keys(batches):
    """Of each row (doc_id, h, text): its set's id, SimHash, size and band keys."""
    shingler = _Shingler()
    for b in _slices(batches):
        sets = [shingler.set(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
        if not sets:
            continue
        made = [bands(s) if len(s) else np.zeros(0, dtype=np.uint64) for s in sets]
        ends = pa.array(np.cumsum([0] + [len(m) for m in made], dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), _signed([set_id(s) for s in sets]), _signed([simhash.majority(_blocks(s)) for s in sets]), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(ends, _signed(np.concatenate(made)))],
            names=[x.split()[0] for x in KEYS.split(", ")],
        )


MEMBERS = "tile long, sid long, root long, shingles binary"
#: Bytes of sets that a batch of members holds about.
HELD = 4 << 20


def _members(batches):
    """Of each row (sid, root, tiles, text): one row per tile. Rows whose text has another set, as a hash met twice, are left out."""
    shingler = _Shingler()
    out, size = [], 0

    def batch():
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in MEMBERS.split(", ")])

    for b in _slices(batches):
        for sid, root, tiles, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3).cast(pa.binary()).to_pylist()):
            own = shingler.set(text)
            if _signed([set_id(own)])[0].as_py() != sid:
                continue
            for tile in tiles:
                out.append((tile, sid, root, own.tobytes()))
                size += own.nbytes
                if size > HELD:
                    yield batch()
                    out, size = [], 0
    if out:
        yield batch()


def _similar(sets: list[np.ndarray]):
    """Pairs (i, j), i < j, of similar sets, as arrays per i. Exact: shared hashes are counted."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        if 9 * len(np.intersect1d(*sets, assume_unique=True)) >= 4 * size.sum():
            yield np.array([0]), np.array([1])
        return
    row = np.repeat(np.arange(n), size)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(number, kind="stable")  # postings: rows by hash, ascending
    held, count = row[order], np.bincount(number)
    start = np.cumsum(count) - count
    first = np.cumsum(size) - size
    for i in range(n - 1):
        mine = number[first[i] : first[i] + size[i]]
        mine = mine[count[mine] > 1]
        if not len(mine):
            continue
        width = count[mine]
        at = np.repeat(start[mine] - np.cumsum(width) + width, width) + np.arange(width.sum())
        shared = np.bincount(held[at], minlength=n)
        shared[: i + 1] = 0
        j = np.flatnonzero(9 * shared >= 4 * (size[i] + size))
        j = j[j > i]
        if len(j):
            yield np.full(len(j), i), j


def _edges(sids, roots, sets):
    """Pairs of components (named by their roots) that the links among a tile's sets connect: a spanning forest."""
    keep = sorted({s: i for i, s in enumerate(sids)}.values())  # a set may come from several rows
    if len(keep) < 2:
        return []
    sets = [np.frombuffer(sets[i], dtype=np.uint64) for i in keep]
    roots = np.array([roots[i] for i in keep], dtype=np.int64)
    first, same = np.unique(roots, return_index=True, return_inverse=True)[1:]
    if len(first) < 2:
        return []
    root = simhash._forest(len(sets), [(first[same], np.arange(len(sets))), *_similar(sets)])
    return [(int(roots[i]), int(roots[root[i]])) for i in first if roots[i] != roots[root[i]]]


def _linked(batches):
    """Rows sorted by tile -> edges (a, b). A tile is held whole; its size is bounded."""
    now, held = None, ([], [], [])
    for b in batches:
        out = []
        for tile, *member in zip(*(b.column(i).to_pylist() for i in range(4))):
            if tile != now:
                out += _edges(*held)
                now, held = tile, ([], [], [])
            for have, x in zip(held, member):
                have.append(x)
        yield _pairs(out)
    yield _pairs(_edges(*held))


def _pairs(edges):
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _hot(sets: int) -> int:
    """More sets than this share a hot key. All sets have BANDS keys, so at most HOT_KEYS keys are hot."""
    return max(HOT_LEAST, sets * BANDS // HOT_KEYS)


def _by_key(rows: DataFrame, keyed: DataFrame, hot: int) -> DataFrame:
    """rows joined to keyed on key; both hold n, the key's number of sets. The rows of a hot key stay where they are."""
    keyed = keyed.withColumnRenamed("n", "_n")
    cold = rows.where(F.col("n") <= hot).join(keyed.where(F.col("_n") <= hot), "key")
    return cold.unionAll(rows.where(F.col("n") > hot).join(F.broadcast(keyed.where(F.col("_n") > hot)), "key")).drop("_n")


def _met(classes: DataFrame, hot: int) -> DataFrame:
    """(key, band, sid, n, weight): the band keys that several sets share, with how many do and how many shingles they have."""
    rows = classes.select("sid", "size", F.posexplode("bands").alias("band", "key"))
    shared = common.stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1"), "jaccard-shared")
    hottest = F.broadcast(shared.where(F.col("n") > hot))
    cold = rows.join(hottest, "key", "left_anti").join(shared.where(F.col("n") <= hot), "key")
    columns = ("key", "band", "sid", "n", "weight")
    met = common.stored(cold.select(*columns).unionAll(rows.join(hottest, "key").select(*columns)), "jaccard-met")
    common.dropped(shared)
    return met


def _tiles(met: DataFrame, classes: DataFrame, roots: DataFrame, first: int, end: int, hot: int) -> DataFrame:
    """(sid, root, tiles) of the sets that must still be compared in the bands first .. end - 1."""
    known = met.where(F.col("band").between(first, end - 1)).join(roots.withColumnRenamed("fp", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    apart = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.first("n").alias("n")).where("low < high").select("key", "n")
    own = _by_key(known, apart, hot)
    if first:  # members that all met before have been compared
        own = common.stored(own.join(classes.select("sid", F.slice("bands", 1, first).alias("early")), "sid"), "jaccard-apart")
        strange = [F.min(F.col("early")[i]) < F.max(F.col("early")[i]) for i in range(first)]
        for s in strange[1:]:
            strange[0] = strange[0] & s
        own = _by_key(own, own.groupBy("key").agg(strange[0].alias("open"), F.first("n").alias("n")).where("open").select("key", "n"), hot)
    blocks = F.greatest(F.ceil(F.col("n") / NODE_SETS), F.ceil(F.col("weight") / NODE_SHINGLES), F.lit(1)).cast("int")
    own = own.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid", "key"), F.col("blocks")).cast("int"))
    tile = lambda j: F.xxhash64("key", F.least(F.col("block"), j), F.greatest(F.col("block"), j))
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), tile)
    return own.select("sid", "root", F.explode(tiles).alias("tile")).groupBy("sid").agg(F.first("root").alias("root"), F.collect_set("tile").alias("tiles"))


def _found(texts: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges (a, b) between the sets of `wanted` that meet in a tile and are similar. texts: (doc_id, h, text)."""
    spark = texts.sparkSession
    wanted = common.stored(wanted.join(classes.select("sid", "rep"), "sid").select("sid", "root", "tiles", F.col("rep.doc_id").alias("_id"), F.col("rep.h").alias("_h")), "jaccard-wanted")
    few = wanted.limit(BROADCAST + 1).count() <= BROADCAST
    ids = wanted.select(F.col("_id").alias("_i"), F.col("_h").alias("_g"))
    # Few keys pick the texts before these are dealt; else the join below deals all.
    near = texts.join(F.broadcast(ids), (texts["h"] == ids["_g"]) & texts["doc_id"].eqNullSafe(ids["_i"]), "left_semi") if few else texts
    rows = near.join(wanted, (near["h"] == wanted["_h"]) & near["doc_id"].eqNullSafe(wanted["_id"])).select("sid", "root", "tiles", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = common.mapped(rows, _members, MEMBERS).repartition(n, "tile").sortWithinPartitions("tile", "sid")
    edges = common.stored(common.mapped(dealt, _linked, "a long, b long").distinct(), "jaccard-links")
    common.dropped(wanted)
    return edges


def _classes(own: DataFrame) -> DataFrame:
    """A row per set: its smallest row (doc_id, null last, and text hash), SimHash, size and band keys."""
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    return own.groupBy("sid").agg(rep.alias("rep"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"))


def components(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(fp, root) of all sets (named fp) that links connect. texts: (doc_id, h, text)."""
    reps = common.stored(classes.groupBy("fp").agg(F.min("sid").alias("rep")), "jaccard-fp")
    same = classes.select("sid", "fp").join(reps, "fp").where("sid <> rep").select(F.col("sid").alias("a"), F.col("rep").alias("b"))
    ends = simhash.links(reps.select("fp")).join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("p")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("q")), "b")
    edges = common.stored(same.unionAll(ends.select(F.col("p").alias("a"), F.col("q").alias("b"))), "jaccard-links")
    hot = _hot(classes.count())
    met = _met(classes, hot)
    roots = simhash.components(edges)
    for first, end in ROUNDS:
        more = _found(texts, classes, _tiles(met, classes, roots, first, end, hot))
        if more.head(1):
            edges = edges.unionAll(more)
            old, roots = roots, simhash.components(edges)
            common.dropped(old)
    common.dropped(met)
    return roots


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("h"), docs["text"])


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, sid) of docs, and classes (sid, root, rep): of each set its component and its smallest row (none, doc_id, h)."""
    texts = _hashed(docs)
    keyed = common.stored(common.mapped(texts, _keys, KEYS), "jaccard-keys")
    classes = common.stored(_classes(keyed), "jaccard-classes")
    own = keyed.select("doc_id", "h", "sid")
    roots = components(texts, classes)
    named = classes.select("sid", "rep").join(roots.withColumnRenamed("fp", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "rep")
    return own, common.stored(named, "jaccard-named")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, sid, component_id) per row of docs; sid names the row's set of shingles."""
    own, classes = classified(docs)
    least = classes.groupBy("root").agg(F.min("rep").alias("least"))
    ids = classes.select("sid", "root").join(least, "root").select("sid", F.col("least.doc_id").alias("component_id"))
    return own.join(ids, "sid").select("doc_id", "sid", "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay when of each component one row stays.

    It is the row with the smallest doc_id (null last); of rows that share this doc_id the
    one with the smallest text hash; of rows that share that, too, the one with the smallest hash
    of all columns. Each row is decided by its own text.
    """
    own, classes = classified(docs)
    stay = classes.groupBy("root").agg(F.min("rep").alias("least")).select(F.col("least.doc_id").alias("_id"), F.col("least.h").alias("_h"))
    counted = own.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.count("*").alias("_n"))
    by = lambda a, b: (a["_h"] == b["_h"]) & a["_id"].eqNullSafe(b["_id"])
    kept = counted.alias("c").join(stay.alias("s"), (F.col("c._h") == F.col("s._h")) & F.col("c._id").eqNullSafe(F.col("s._id")), "left")
    fate = common.stored(kept.select("c._id", "c._h", "c._n", F.col("s._h").isNotNull().alias("_stays")), "jaccard-fate")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("_id"), F.xxhash64(docs["text"]).alias("_h"))
    goes, several = fate.where("not _stays"), fate.where("_stays and _n > 1")
    out = rows.join(goes, by(rows, goes), "left_anti")
    if several.head(1):
        again = rows.join(several, by(rows, several), "left_semi").groupBy("_id", "_h").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        out = out.join(several, by(out, several), "left_anti").select("row").unionAll(again.select("row"))
    return out.select("row.*")
