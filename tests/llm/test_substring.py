import hashlib
import random
import re

from streamql.llm import substring


def brute(rows, width=50):
    first, docs = {}, []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        docs.append((d, w))
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    run = lambda n: [word() for _ in range(n)]
    hot, passages = run(55), [run(n) for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(150):
        t = run(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            k = rng.randint(0, len(t))
            t[k:k] = p[a : a + rng.randint(30, 200)]
        if i % 3 == 0:
            t += hot
        rows.append([i, " ".join(t)])
    # One id under several texts, short and long, and rows that share a passage with a smaller id.
    rows += [[310, "short text"], [310, " ".join(run(300))], [310, " ".join(run(200) + passages[4])], [310, ""], [310, None], [311, " ".join(passages[4])], [-5, " ".join(run(30) + passages[3])]]
    rows += [[None, " ".join(passages[4] + run(i))] for i in range(5)]
    rows += [[200 + i, rows[i * 7][1].replace(" ", "\n")] for i in range(10)] + [[300, "x " * 400], [301, "x " * 130], [302, None], [303, ""], [None, rows[3][1]], [3, rows[3][1]], [304, " ".join(passages[4]) + " tail"]]
    return rows


def test_cover_and_hashes():
    shifts = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert shifts == set(range(substring.PERIOD)) and substring.PERIOD + substring.ANCHOR - 1 == substring.WINDOW
    h = substring._Hasher()
    codes = h.codes(b"a b c a b c d")
    w = h.windows(codes, 3, substring.MULTIPLIERS[0])
    assert len(w) == 5 and w[0] == w[3] and len(set(w.tolist())) == 4


def test_digest_against_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", None) for r in rows], "doc_id long, text string, lost string, pos int").repartition(5)
    want = sorted(map(str, (x[:4] for x in brute(rows))))
    assert sorted(str(tuple(r)) for r in substring.dedup_digest(df).collect()) == want
    monkeypatch.setattr(substring, "CHUNK", 2000)
    assert sorted(str(tuple(r)) for r in substring.dedup_digest(df).collect()) == want
    assert substring.dedup_digest(df.limit(0)).collect() == []


def test_dedup_rewrites_texts(spark):
    rows = corpus(2)
    df = spark.createDataFrame([(d, t, len(t or ""), "z") for d, t in rows], "doc_id long, text string, n_chars long, known string")
    out = substring.dedup(df)
    assert out.columns == df.columns
    want = []
    for (d, t), (_, n, gone, _, kept) in zip(rows, brute(rows)):
        if not gone:
            want.append((d, t, len(t or "")))
        elif kept:
            want.append((d, " ".join(kept), len(" ".join(kept))))
    assert sorted(str((r.doc_id, r.text, r.n_chars)) for r in out.collect()) == sorted(map(str, want))


def test_one_id_under_several_texts(spark):
    rng = random.Random(4)
    run = lambda n: [f"w{rng.getrandbits(30)}" for _ in range(n)]
    passage = run(60)
    rows = [[1, " ".join(passage)], [2, " ".join(run(200) + passage)], [2, " ".join(run(300))], [2, "short text"], [2, None]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(str(tuple(r)) for r in substring.dedup_digest(df).collect())
    assert got == sorted(str(x[:4]) for x in brute(rows)) and sorted(r.n_removed for r in substring.dedup_digest(df).collect()) == [0, 0, 0, 0, 60]


def test_equal_windows_travel_as_one_row():
    import pyarrow as pa

    text = ("x " * 5000).encode()
    chunk = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text]), pa.array([0, 0]), pa.array([list(range(4981))] * 2)], names=["doc_id", "text", substring.VERSION, substring.ANCHORS])
    out = [r for b in substring._shared_windows([chunk]) for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["n"]) for r in out) == [(1, 4951), (2, -4951)]
    text = ("a line of seven words said again " * 700).encode()
    chunk = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text]), pa.array([0, 0]), pa.array([list(range(4881))] * 2)], names=["doc_id", "text", substring.VERSION, substring.ANCHORS])
    out = [r for b in substring._shared_windows([chunk]) for r in b.to_pylist()]
    assert len(out) == 8 and max(r["n"] for r in out) == 4845


def test_repeated_lines_against_brute_force(spark):
    rng = random.Random(12)
    run = lambda n: [f"w{rng.getrandbits(20)}" for _ in range(n)]
    lines = [run(n) for n in (1, 3, 7, 49, 50, 51, 120)]
    rows = [[i, " ".join(run(rng.randint(0, 40)) + lines[i % 7] * rng.randint(1, 60) + run(rng.randint(0, 40)) + lines[i % 7] * 3)] for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(str(tuple(r)) for r in substring.dedup_digest(df).collect()) == sorted(str(x[:4]) for x in brute(rows))
