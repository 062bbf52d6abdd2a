import random

from tokenizers import Tokenizer

from streamql.llm import encoding, tokencount


def counter():
    return tokencount.Counter(encoding.read_spec())


def reference():
    t = Tokenizer.from_file(encoding.tokenizer_path())
    t.encode_special_tokens = True
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def random_text(rng, n):
    return "".join(rng.choice(["the ", "a", " ", "  ", "\n", "'s", "x1 ", "été", "12", " !?", "word", "\t "]) for _ in range(n))


def test_edits_equal_a_full_count():
    c, full, rng = counter(), reference(), random.Random(4)
    for n in (0, 1, 30, 3000):
        tree = tokencount.Tree(c, random_text(rng, n))
        for step in range(60):
            size = len(tree.text)
            tree.encoded = 0
            tree.edit(rng.randint(-2, size + 2), rng.choice([0, 1, 5, rng.randint(0, size // 3 + 1) if step % 20 == 0 else 2]), random_text(rng, rng.choice([0, 1, 4, 4, 200 if step % 15 == 0 else 1])))
            assert tree.n_tokens == full(tree.text) and tree.pretokens == len(c.pattern.findall(tree.text))
            assert tree.heap[1, 0] == len(tree.text)
            m = len(tree.heap) // 2
            for i in range(1, m):
                assert (tree.heap[i] == tree.heap[2 * i] + tree.heap[2 * i + 1]).all()


def test_small_edits_encode_little():
    c = counter()
    tree = tokencount.Tree(c, "some plain words in a row " * 20000)
    tree.encoded = 0
    tree.edit(260000, 3, "other")
    assert tree.encoded < 3 * tokencount.LEAF * 6


def test_edits_touch_paths_only():
    """Many edits in one place fill its leaf and then split it; in between the tree keeps its leaves, and each edit reads few of its rows."""
    c, full = counter(), reference()
    tree = tokencount.Tree(c, "plain words in a row " * 3000)
    built, at = 0, 30_000
    heap = tree.heap
    for i in range(400):
        tree.edit(at, 0, f" new{i}")
        built += tree.heap is not heap
        heap = tree.heap
    assert 1 <= built <= 400 * 2 // (tokencount.FULL - tokencount.LEAF) + 1
    tree.edit(10, 50_000, "")
    tree.edit(0, 0, "start ")
    assert tree.n_tokens == full(tree.text) and tree.heap[1, 0] == len(tree.text)


def test_frames(spark):
    full, rng = reference(), random.Random(5)
    rows = [(i, random_text(rng, rng.choice([0, 3, 400])), "x") for i in range(40)] + [(50, None, ""), (51, "", None), (3, "again", ""), (None, "no id", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    state = tokencount.build(df)
    assert sorted((str(r.doc_id), r.n_tokens) for r in state.collect()) == sorted((str(d), full(t or "")) for d, t, _ in rows)
    changes = [(i % 45, s, rng.randint(0, 300), rng.randint(0, 9), rng.choice(["new ", None, "\n", "x"])) for s, i in enumerate(range(200))] + [(999, 0, 0, 0, "lost"), (None, 0, 0, 0, "lost")]
    edits = spark.createDataFrame(changes, "doc_id long, seq long, start int, length int, replacement string").repartition(2)
    want = []
    for d, t, _ in rows:
        t = t or ""
        for e in changes:
            if d is not None and e[0] == d:
                a = min(e[2], len(t))
                t = t[:a] + (e[4] or "") + t[min(a + e[3], len(t)) :]
        want.append((str(d), t, full(t)))
    assert sorted((str(r.doc_id), r.text, r.n_tokens) for r in tokencount.apply_edits(state, edits).collect()) == sorted(want)
    assert tokencount.build(df.limit(0)).collect() == [] and tokencount.apply_edits(state.limit(0), edits).collect() == []
