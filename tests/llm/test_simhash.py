import random
import re

import numpy as np
import xxhash

from streamql.llm import simhash


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, radius=2):
    left, out = set(fps), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            x = todo.pop()
            group.append(x)
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            todo += near
        out |= {x: min(group) for x in group}
    return out


def cloud(n, seed=7):
    """Random codes, a dense ball around one code and chains."""
    rng = random.Random(seed)
    codes = {rng.getrandbits(64) for _ in range(n)}
    c = rng.getrandbits(64)
    codes |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(n)}
    for _ in range(5):
        x = rng.getrandbits(64)
        for _ in range(30):
            x ^= 1 << rng.randrange(64) ^ rng.choice([0, 1])
            codes.add(x & (2**64 - 1))
    return sorted(codes | {0, 2**64 - 1})


def test_fingerprint():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 4, 50, 40000]:
        t = "".join(rng.choice(["Foo", "bar", "É", "x", "BAZ1"]) + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(n))
        assert simhash.fingerprint(t.encode()) == brute_fp(t)
    assert simhash.fingerprint(b"  \n") == 0


def test_index_finds_every_link_once():
    codes = np.array(cloud(400), dtype=np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.diff(simhash.gray_rank(codes).astype(object)) > 0).all()
    got = [(int(i), int(j)) for a, b in simhash._links(codes, 2) for i, j in zip(a, b)]
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_with_hot_nodes(spark):
    codes = cloud(300, 3)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in codes], "fp long").repartition(3)
    want = brute_components(codes)
    groups = {}
    for x, r in want.items():
        groups.setdefault(r, set()).add(x)
    edges = simhash.links(df, limit=20)
    got = {}
    for r in simhash.components(edges).collect():
        got.setdefault(r.root, set()).add(r.fp % (1 << 64))
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_near_duplicates(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(200)]
        for j in range(rng.choice([1, 1, 3])):
            u = list(t)
            if j:
                u[rng.randrange(200)] = "changed"
            rows.append((len(rows) + 10, " ".join(u), "x"))
    rows += [(500, None, None), (3, "", "y"), (501, "  ", ""), (502, "One two", ""), (502, "one TWO", ""), (None, "one two", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    fps = [brute_fp(t) for _, t, _ in rows]
    comp = brute_components(set(fps))
    least = {}
    for (d, *_), f in zip(rows, fps):
        if d is not None:
            least[comp[f]] = min(d, least.get(comp[f], d))
    got = simhash.near_duplicates(df).collect()
    want = sorted((str(d), f, least[comp[f]]) for (d, *_), f in zip(rows, fps))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).collect() == []
