import random

import numpy as np

import corpus_pipeline
from streamql.llm import jaccard, simhash

from .test_simhash import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def set_fp(text):
    """Bit by bit: set in over half of the distinct shingles' hashes."""
    own = jaccard._Shingler().set((text or "").encode()).tolist()
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own))


def brute(rows):
    """doc_id -> smallest doc_id of the component, by all pairs."""
    sets, fp = {d: shingles(t) for d, t in rows}, {d: set_fp(t) for d, t in rows}
    comp, root = brute_components(set(fp.values())), {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for i in ids:
        for j in ids:
            if j > i and (comp[fp[i]] == comp[fp[j]] or similar(sets[i], sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d in ids}


def edited(rng, words, n):
    """words with n of them replaced."""
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.getrandbits(40)}"
    return out


def planted(rng):
    """Unrelated texts, near copies around the bound, chains, a hot group, a shared passage, short texts."""
    text = lambda n: [f"w{rng.getrandbits(30)}" for _ in range(n)]
    passage, hot, out = text(70), text(120), []
    for i in range(40):
        base = text(rng.randint(30, 200))
        out += [base, edited(rng, base, 1 + i % 4), base[: len(base) * (78 + i % 6) // 100]]
    for _ in range(4):
        link = text(150)
        for _ in range(6):
            out.append(link := edited(rng, link, 2))
    out += [edited(rng, hot, rng.randint(1, 3)) for _ in range(60)]
    out += [passage + text(rng.randint(5, 60)) for _ in range(40)]
    out += [text(n) for n in range(1, 10) for _ in range(2)]
    out += [t[:-1] + ["other"] for t in out[-18:]] + [hot, hot]
    texts = [" ".join(t).upper() if i % 9 == 0 else " ".join(t) for i, t in enumerate(out)] + [None, "", " \n"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_are_those_of_all_pairs(spark, monkeypatch):
    for seed, most, hot in [(1, 1024, 256), (2, 12, 3)]:  # 12: hot nodes are cut into blocks; 3: hot keys are broadcast
        monkeypatch.setattr(jaccard, "NODE_SETS", most)
        monkeypatch.setattr(jaccard, "HOT_LEAST", hot)
        rows = planted(random.Random(seed))
        got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert {r.doc_id: r.component_id for r in got} == brute(rows)
        assert len(got) == len(rows)


def test_hot_keys_are_bounded(monkeypatch):
    for sets in (0, 1, 5000, 10**6, 10**10):
        assert sets * jaccard.BANDS // (jaccard._hot(sets) + 1) <= jaccard.HOT_KEYS
    monkeypatch.setattr(jaccard, "HOT_LEAST", 0)
    assert jaccard._hot(jaccard.HOT_KEYS) == jaccard.BANDS


def test_bands_find_what_is_similar():
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(400):
        common, own = rng.integers(0, 2**63, 89, dtype=np.uint64), rng.integers(0, 2**63, (2, 11), dtype=np.uint64)
        a, b = (jaccard.bands(np.unique(np.concatenate((common, x)))) for x in own)  # 89 of 111
        lost += not (a == b).any()
    assert lost == 0
    assert not (jaccard.bands(own[0]) == jaccard.bands(own[1])).any() and len(set(jaccard.bands(own[0][:1]).tolist())) == jaccard.BANDS


def test_pairs_of_a_node_are_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(60) < 0.93], rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)))) for _ in range(50)]
    for some in (sets, sets[:2], sets[:3]):
        got = {(int(i), int(j)) for a, b in jaccard._similar(some) for i, j in zip(a, b)}
        want = {(i, j) for i in range(len(some)) for j in range(i + 1, len(some)) if 5 * len(np.intersect1d(some[i], some[j])) >= 4 * len(np.union1d(some[i], some[j]))}
        assert got == want


def test_stage_removes_planted_near_copies(spark):
    rng = random.Random(5)
    base = [[f"w{rng.getrandbits(30)}" for _ in range(150)] for _ in range(30)]
    copies = [edited(rng, b, 2) for b in base]
    assert all(similar(shingles(" ".join(a)), shingles(" ".join(b))) for a, b in zip(base, copies))
    assert sum((set_fp(" ".join(a)) ^ set_fp(" ".join(b))).bit_count() > 2 for a, b in zip(base, copies)) > 15
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(base + copies)]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in left.collect()) == list(range(30))


def test_what_one_set_of_a_group_does_not_reach(spark):
    # b and c link to each other, not to a, but all meet in shared shingles.
    rng = random.Random(8)
    w = [f"w{rng.getrandbits(30)}" for _ in range(200)]
    rows = [(1, " ".join(w[:150])), (2, " ".join(w[35:190])), (3, " ".join(w[38:192]))]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows) == {1: 1, 2: 2, 3: 2}


def test_every_row_is_decided_by_its_own_text(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.getrandbits(30)}" for _ in range(80))
    a, b, c = text(), text(), text()
    near = " ".join(edited(rng, a.split(), 1))
    rows = [
        (1, a, "x", 1), (1, a, "x", 1), (1, a, "x", 2), (1, b, "x", 1), (2, near, "x", 1), (2, c, "x", 1), (3, c, "x", 1),
        (None, b, "x", 1), (None, text(), "x", 1), (None, None, "x", 1), (7, "", "x", 1), (8, " ", "x", 1), (None, text(), "x", 3),
    ]
    rows += [rows[-1]] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, sid int").repartition(5)
    for _ in range(2):
        left = jaccard.survivors(df)
        assert left.columns == df.columns
        got = sorted(map(str, left.collect()))
        firsts = [r for r in got if str(a) in r]
        assert len(firsts) == 1
        want = [(1, b), (2, c), (None, rows[8][1]), (7, ""), (None, rows[12][1])]
        assert sorted(str((r.doc_id, r.text)) for r in left.collect() if r.text != a) == sorted(map(str, want))
    assert jaccard.survivors(df.limit(0)).collect() == [] and jaccard.near_duplicates(df.limit(0)).collect() == []
    assert [r.doc_id for r in jaccard.survivors(df.where("text is null")).collect()] == [None]
