import random
import re

from streamql.llm import mixing


def level(sizes, weights=(5, 2, 1), cap=3.0):
    """Share by weight, cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= cap * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            open_.remove(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, key int")


def test_targets_and_copies(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 40))), rng.choice(["a", "a", "a", "b", "c", "é", None]), "x", 1) for i in range(3000)]
    rows += [(7, None, "b", None, None), (None, "one two", "c", None, None), (8, "", "empty", None, None)]
    got = mixing.mix_sizes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = level(sizes), {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 40
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sizes(frame(spark, rows)).collect()))


def test_copies_have_the_stated_probability(spark):
    """Over many sources of one shape the mean number of copies of each document is the rate: one document, a few, and null ids."""
    shapes = {"a": [(True, 40)], "b": [(True, 5 + 13 * i) for i in range(9)], "c": [(False, 7)] * 12, "d": [(True, 400)]}
    rows, n = [], 250
    for i in range(n):
        for shape, docs in shapes.items():
            for j, (known, size) in enumerate(docs):
                rows.append((len(rows) if known else None, f"w{j}x{i} " + "w " * (size - 1), f"{shape}{i:03}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    place = {r[:2]: r[1].split("x")[0] for r in rows}
    seen = {}
    for r in mixing.mixed(docs, weights=(1,)).collect():
        k = r.source[0], place[r.doc_id, r.text]
        seen[k] = seen.get(k, 0) + 1
    rates = {r.source[0]: r.target / r.source_size for r in mixing.mix_sizes(docs, weights=(1,)).collect()}
    assert any(x % 1 for x in rates.values())
    for shape, some in shapes.items():
        for j in range(len(some)):
            assert abs(seen.get((shape, f"w{j}"), 0) / n - rates[shape]) < 0.13, (shape, j)  # four standard errors of a fair draw


def test_one_document_sources(spark):
    """The draw of a source of one document is fair over its ids, too."""
    docs = spark.createDataFrame([(i, "w " * 10, f"s{i:04}") for i in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix_sizes(docs).collect()
    for part in range(3):
        some = [r for i, r in enumerate(sorted(got, key=lambda r: r.source)) if i % 3 == part]
        rate = some[0].target / 10
        assert abs(sum(r.copies for r in some) / len(some) - rate) < 0.08


def test_mixed_repeats_rows_and_keeps_columns(spark):
    rows = [(i, "a b c", "s" if i % 3 else "t", "x", i) for i in range(300)]
    df = frame(spark, rows)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    plan = {r.doc_id: r.copies for r in mixing.mix_sizes(df).collect()}
    n = {}
    for r in out.collect():
        assert r["key"] == r.doc_id
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert n == {k: v for k, v in plan.items() if v}


def test_empty(spark):
    assert mixing.mix_sizes(frame(spark, [])).collect() == []
    assert mixing.mixed(frame(spark, [])).collect() == []
