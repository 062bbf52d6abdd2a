import math
import random

import numpy as np

from streamql.llm import topk


def brute(rows, k=5):
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for q in v:
        if q % 50 == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v[q], e)))), i) for i, e in v.items() if i != q)[:k]
            out |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s)}
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, score string, rank int").repartition(3)
    ints = topk.integer_rows(df)
    return {tuple(r) for r in topk.search(ints.where("vec_id % 50 = 0"), ints, **kw).collect()}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # a hot vector: many ties
    rows += [(2000, None), (2001, [1.0, None]), (2050, [float("nan")] * 8), (2051, [float("inf")] * 8), (2100, []), (2101, [1.0]), (None, [1.0] * 8)]
    monkeypatch.setattr(topk, "C_BLOCK", 128)
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, chunk=4) == brute(rows)


def test_one_very_long_vector(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)] + [(400, [0.5] * 3000), (401, [0.25] * 2000)]
    monkeypatch.setattr(topk, "CELLS", 4000)
    assert found(spark, rows) == brute(rows)
    for widths in ([4] * 50 + [3000] + [4] * 50, [], [9000], [1] * 10_000):
        ends = topk._cuts(np.array(widths, dtype=int))
        assert ends[-1] == len(widths)
        for a, z in zip([0, *ends], ends):
            assert z - a <= topk.C_BLOCK and (z - a <= 1 or (z - a) * max(widths[a:z]) <= 4000)


def test_huge_components_and_empty(spark):
    rows = [(0, [1e30, -3.0]), (1, [1e30, 2.0]), (2, [-1e30, 2.0]), (50, [2.0, 2.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == set()
