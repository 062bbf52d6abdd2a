"""Edit-aware token counts.

A document's pre-tokens are grouped into leaves (LEAF pre-tokens, or LEAF runs of them that
start at a space); a segment tree holds for every
subtree its characters and its tokens. An edit goes down by characters to the leaf
before its first changed character, pre-tokenises from that leaf's start, and stops as
soon as a pre-token ends where an untouched leaf begins: from there on the text, and so
its tokens, are what they were. Only that region is encoded; the leaf sums change and
with them the sums on the paths above: an edit costs its region and the tree's height, besides
the copy of the text. A leaf that has grown FULL has the tree built anew over its leaves, once
in so many insertions.

Pre-tokens never look back, and forward by one character at most, which is why the
leaf that holds the character before the edit is context enough.

Defined results. Strings of special tokens are ordinary text. Null text: no pre-token, 0 tokens; edits treat it as empty. An edit's
start and length are cut to the text. A null replacement deletes. Edits of a document
apply in order of seq (null first, then start, length, replacement). Edits of unknown
documents or without doc_id are ignored. Rows that repeat a doc_id are counted each; in
apply_edits() the edits go to every one of them. Empty table: empty result.
"""

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import UNSAFE, encoder, read_spec

LEAF = 16
#: Pre-tokens of a leaf that edits have filled; beyond, the leaves are dealt anew.
FULL = 8 * LEAF
STATE = "doc_id long, text string, n_tokens long, n_pretokens long, tree_chars array<int>, tree_tokens array<int>"


class _Runs(dict):
    """Text between spaces -> tokens << 32 | pre-tokens of it, the space in front included; bounded."""

    def __init__(self, counter, prefix):
        self.counter, self.prefix = counter, prefix

    def __missing__(self, piece):
        whole = self.prefix + piece
        n = len(self.counter.ids(whole)) << 32 | len(self.counter.pattern.findall(whole))
        if len(piece) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Tokens per pre-token, remembered in a bounded cache."""

    def __init__(self, spec):
        self.ids, self.cached = encoder(spec).ids, {}
        self.pattern = regex.compile(spec[1])
        self.first, self.rest = _Runs(self, ""), _Runs(self, " ")

    def runs(self, text: str):
        """(characters, tokens) of the runs of pre-tokens that start at a space, and the number of pre-tokens; None where a space may stand inside one."""
        if UNSAFE.search(text):
            return None
        head, *tail = text.split(" ")
        packed = np.fromiter(map(self.rest.__getitem__, tail), np.int64, len(tail))
        packed = np.concatenate(([self.first[head]], packed))
        chars = np.fromiter(map(len, tail), np.int64, len(tail)) + 1
        return np.stack((np.concatenate(([len(head)], chars)), packed >> 32), axis=1), int((packed & 0xFFFFFFFF).sum())

    def tokens(self, pretoken: str) -> int:
        n = self.cached.get(pretoken)
        if n is None:
            n = len(self.ids(pretoken))
            if len(pretoken) <= 64:
                if len(self.cached) >= 400_000:
                    self.cached.clear()
                self.cached[pretoken] = n
        return n


def _heap(leaves: np.ndarray) -> np.ndarray:
    """Sums over (leaves, 2) as a heap: node 1 is the root, node i has the children 2i and 2i + 1."""
    m = 1 << max(0, int(len(leaves) - 1).bit_length())
    heap = np.zeros((2 * m, 2), dtype=np.int64)
    heap[m : m + len(leaves)] = leaves
    while m > 1:
        m //= 2
        heap[m : 2 * m] = heap[2 * m : 4 * m : 2] + heap[2 * m + 1 : 4 * m : 2]
    return heap


class Tree:
    """A text and the segment tree of its (characters, tokens)."""

    def __init__(self, counter: Counter, text: str, heap=None, pretokens: int = 0):
        self.counter, self.text, self.encoded = counter, text, 0
        if heap is not None:
            self.heap, self.pretokens = heap, pretokens
            return
        runs = counter.runs(text)
        if runs is None:
            sizes = self._sizes(counter.pattern.findall(text))
            self.pretokens = len(sizes)
        else:
            sizes, self.pretokens = runs
        self.heap = _heap(self._grouped(sizes))

    def _sizes(self, pretokens):
        self.encoded += sum(map(len, pretokens))
        return np.array([(len(p), self.counter.tokens(p)) for p in pretokens], dtype=np.int64).reshape(-1, 2)

    @staticmethod
    def _grouped(sizes):
        return np.add.reduceat(sizes, np.arange(0, len(sizes), LEAF), axis=0) if len(sizes) else np.zeros((1, 2), dtype=np.int64)

    @property
    def n_tokens(self) -> int:
        return int(self.heap[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, and where it starts."""
        node, start, m = 1, 0, len(self.heap) // 2
        while node < m:
            node *= 2
            if at >= start + self.heap[node, 0]:
                start += int(self.heap[node, 0])
                node += 1
        return node - m, start

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replace `length` characters from `start` on. Touches the leaves of the region and the paths above them."""
        start = min(max(0, start), len(self.text))
        end = min(start + max(0, length), len(self.text))
        m = len(self.heap) // 2
        leaf, begin = self.find(max(0, start - 1)) if self.text else (0, 0)
        text = self.text[:start] + replacement + self.text[end:]
        shift, behind = len(text) - len(self.text), start + len(replacement)
        # Old and new can meet again where a leaf ends that lies behind the edit: the first of these is found from the root.
        at, stop = self.find(end - 1) if end > start else (leaf, begin)
        stop += int(self.heap[m + at, 0])
        found, last = [], m
        for match in self.counter.pattern.finditer(text, begin):
            found.append(match[0])
            here = match.end()
            if here > behind:
                while stop + shift < here and at + 1 < m:
                    at += 1
                    stop += int(self.heap[m + at, 0])
                if stop + shift == here:
                    last = at + 1
                    break
        if last == m:
            stop = len(self.text)
        gone = 0
        for match in self.counter.pattern.finditer(self.text, begin):  # the whole old text, as a slice's end would look like the text's
            if match.end() > stop:
                break
            gone += 1
        self.pretokens += len(found) - gone
        self.text = text
        sizes, slots = self._sizes(found), last - leaf
        each = max(1, -(-len(sizes) // slots))
        if each <= FULL:  # in place: a leaf may grow to FULL pre-tokens
            new = np.add.reduceat(sizes, np.arange(0, len(sizes), each), axis=0) if len(sizes) else sizes
            self.heap[m + leaf : m + last] = 0
            self.heap[m + leaf : m + leaf + len(new)] = new
            low, high = m + leaf, m + last - 1
            while low > 1:
                low, high = low // 2, high // 2
                self.heap[low : high + 1] = self.heap[2 * low : 2 * high + 2 : 2] + self.heap[2 * low + 1 : 2 * high + 2 : 2]
        else:  # leaves are dealt anew, after FULL - LEAF new pre-tokens at least; nothing is encoded for it
            leaves = np.concatenate((self.heap[m : m + leaf], self._grouped(sizes), self.heap[m + last :]))
            used = np.flatnonzero(leaves[:, 0])
            self.heap = _heap(leaves[used] if len(used) else leaves[:1])


def build(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The state table: per row of docs its text, counts and tree."""
    return _mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), _built, STATE, tokenizer)


def _mapped(df, work, schema, tokenizer):
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def rows(batches):
        yield from work(batches, Counter(spec.value))

    return df.mapInArrow(rows, schema)


def _state_row(doc, tree):
    return doc, tree.text, tree.n_tokens, tree.pretokens, tree.heap[:, 0].tolist(), tree.heap[:, 1].tolist()


def _state_batch(out):
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in STATE.split(", ")])


def _built(batches, counter):
    for b in batches:
        out = [_state_row(doc, Tree(counter, text or "")) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if out:
            yield _state_batch(out)


def apply_edits(state: DataFrame, edits: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The state table after edits (doc_id, seq, start, length, replacement).

    A document's row and its edits meet in one partition, sorted, and are streamed: the
    edits of a document may be any number.
    """
    none = lambda kind: F.lit(None).cast(kind)
    docs = state.select("doc_id", F.lit(0).alias("kind"), none("long").alias("seq"), none("int").alias("start"), none("int").alias("length"), "text", "n_pretokens", "tree_chars", "tree_tokens")
    changes = edits.where("doc_id is not null").select(
        F.col("doc_id").cast("long"), F.lit(1).alias("kind"), F.col("seq").cast("long"), F.coalesce(F.col("start").cast("int"), F.lit(0)).alias("start"), F.coalesce(F.col("length").cast("int"), F.lit(0)).alias("length"),
        F.coalesce("replacement", F.lit("")).alias("text"), none("long").alias("n_pretokens"), none("array<int>").alias("tree_chars"), none("array<int>").alias("tree_tokens"),
    )
    n = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = docs.unionByName(changes).repartition(n, "doc_id").sortWithinPartitions("doc_id", "kind", "seq", "start", "length", "text")

    def work(batches, counter):
        held, now = [], None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if held and (r["doc_id"] != now or r["doc_id"] is None):
                    out += [_state_row(now, t) for t in held]
                    held = []
                if r["kind"] == 0:
                    now = r["doc_id"]
                    held.append(Tree(counter, r["text"], np.stack([r["tree_chars"], r["tree_tokens"]], axis=1).astype(np.int64), r["n_pretokens"]))
                else:
                    for t in held:
                        t.edit(r["start"], r["length"], r["text"])
            if out:
                yield _state_batch(out)
        if held:
            yield _state_batch([_state_row(now, t) for t in held])

    return _mapped(stream, work, STATE, tokenizer)


def count_edited(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Counts before and after the edits a row brings along in `edits`, an array of (start, length, replacement).

    (doc_id, n_tokens, n_pretokens, n_tokens_edited, n_pretokens_edited, reencoded_chars); no shuffle.
    """
    names = ["doc_id", "n_tokens", "n_pretokens", "n_tokens_edited", "n_pretokens_edited", "reencoded_chars"]

    def work(batches, counter):
        for b in batches:
            out = []
            for doc, text, edits in zip(*(b.column(i).to_pylist() for i in range(3))):
                tree = Tree(counter, text or "")
                before = (tree.n_tokens, tree.pretokens)
                tree.encoded = 0
                for e in edits or ():
                    tree.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
                out.append((doc, *before, tree.n_tokens, tree.pretokens, tree.encoded))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], docs["edits"])
    return _mapped(rows, work, ", ".join(f"{n} long" for n in names), tokenizer)


def op9_tokens(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents, before and after three edits each: one in the middle, one near the start, one at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda start, length, new: F.struct(start.cast("int").alias("start"), F.lit(length).alias("length"), F.lit(new).alias("replacement"))
    edits = F.array(edit(F.floor(n / 2), 7, " revised  wording"), edit(F.floor(n / 7), 12, ""), edit(n + 5, 0, "\nadded line."))
    return count_edited(docs.withColumn("edits", edits))
