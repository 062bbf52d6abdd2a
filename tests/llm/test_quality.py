import random
import re
from collections import Counter

import numpy as np

from streamql.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def texts():
    rng = random.Random(5)
    out = [None, "", " \t\n", "a", "a b c d e a b c d e", "é\xa0x y z", "a\n\na\n a\na", "w " * 30000, "# * | x" * 20]
    for _ in range(300):
        vocab = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([3, 8, 200]))]
        out.append("".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "  ", "\r\n"]) for _ in range(rng.randint(1, 60))))
    return out


def test_statistics():
    for t in texts():
        assert quality.statistics((t or "").encode())[0] == brute(t), t


def test_trees_are_monotonic_and_flattened():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(5 * x[:, 1]) < 0.6).astype(float)
    m = quality.fit(x, y, [-1, 0, 0])
    assert (((m.margins(x) > 0) == y).mean()) > 0.93
    grid = np.repeat(rng.uniform(size=(50, 3)), 100, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 100), 50)
    assert (np.diff(m.margins(grid).reshape(50, 100), axis=1) <= 1e-12).all()

    def walk(row, i):
        while m.left[i] != i:
            i = m.left[i] if row[m.feature[i]] <= m.cut[i] else m.right[i]
        return m.value[i]

    assert np.allclose(m.margins(x[:20]), [m.start + sum(walk(r, i) for i in m.roots) for r in x[:20]])


def test_assess_and_keep(spark):
    rng = random.Random(2)
    clean = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)) + "."
    junk = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) + "$$$" for _ in range(60))
    rows = [(i, junk() if i % 4 == 0 else clean(), "x", i) for i in range(400)] + [(1000 + i, t, None, None) for i, t in enumerate(texts()[:9])]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, score long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 2)] + [(None, 1)], "doc_id long, quality int")
    model = quality.train(df, labels)
    got = {r.doc_id: r for r in quality.assess(df, model).collect()}
    for i, t, *_ in rows:
        r = got[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
        if i < 400:
            assert r.kept == (i % 4 > 0)
    kept = quality.keep(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}
    assert quality.train(df, labels.limit(0)) is None and quality.assess(df.limit(0), None).collect() == []


def test_sample_is_bounded_by_id(spark):
    rows = [(i, "good words here. " * 5 + str(i)) for i in range(200)] + [(7, f"$$$ *** {i}") for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 1)] * 5000 + [(9, 0)] * 5000, "doc_id long, quality int")
    seen = []
    fit, quality.fit = quality.fit, lambda x, y, *a, **k: seen.append(y) or fit(x, y, *a, **k)
    try:
        assert quality.train(df, labels) is not None and quality.train(df, labels, max_labels=50) is not None
    finally:
        quality.fit = fit
    assert [len(y) for y in seen] == [200, 50] and seen[0].sum() == 99


def test_verdict_against_walked_trees(spark):
    """kept, from statistics and trees worked out one document and node at a time."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7)))
    rows = [(i, " ".join(word() + rng.choice(["", "!", "$"] if i % 2 else [""]) for _ in range(rng.randint(5, 60)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = quality.train(df, spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(300)], "doc_id long, quality int"))

    def features(t):
        w = t.split()
        n, chars = len(w), len("".join(w))
        _, _, symbols, dup, repeated = brute(t)
        share = lambda good: sum(map(good, t)) / chars
        return [np.log1p(n), chars / n, symbols / chars, repeated / n, dup, share(str.isupper), share(lambda c: c in ".,;:!?"), share(lambda c: c == "!"), share(str.isdigit), len(set(w)) / n, n, 0.0]

    def margin(x):
        total = m.start
        for i in m.roots:
            while m.left[i] != i:
                i = m.left[i] if x[m.feature[i]] <= m.cut[i] else m.right[i]
            total += m.value[i]
        return total

    for r in quality.assess(df, m).collect():
        t = rows[r.doc_id][1]
        assert r.kept == (not r.base_failed and margin(features(t)) >= m.threshold)
