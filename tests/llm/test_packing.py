import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from streamql.llm import encoding, packing


def reference(ordinary=False):
    t = Tokenizer.from_file(encoding.tokenizer_path())
    if ordinary:
        t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(9)
    alphabet = list("ab Z  \n\t\r.,'1é漢😀  \x1c") + ["'s", "'ll", " the", "\n\n  ", "<|endoftext|>"]
    return ["", " ", "  ", "a ", " a", "a \n", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000))]


def test_encoder_equals_tokenizers():
    ids, plain, enc = reference(), reference(ordinary=True), encoding.encoder(encoding.read_spec())
    assert ids("a <|endoftext|> b") == [64, 220, 50256, 275]
    for t in odd_texts() + ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> ", "x\n <|endoftext|>"]:
        assert np.frombuffer(enc.encode(t, special=True), "<u4").tolist() == ids(t), repr(t)
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == plain(t), repr(t)


def test_solver_keeps_every_capacity():
    rng = random.Random(1)
    for documents, cost, rule in ((64, 64 * 64, "residual_norm"), (3, 64 * 64, "residual_norm"), (64, 900, "dot_product"), (5, 1500, "dot_product")):
        hist = Counter(rng.choice([rng.randint(1, 30), rng.randint(1, 30), 7]) for _ in range(5000))
        runs, opened = packing.solve(hist, 64, documents, cost, (1.0, 0.5, 0.5), rule)
        bins, seen = defaultdict(list), Counter()
        for length, rank, m, first, offset in runs.tolist():
            for i in range(m):
                bins[first + i].append((offset, length))
                seen[length, rank + i] += 1
        assert set(seen.values()) == {1} and Counter(k for k, _ in seen) == hist and len(bins) == opened
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == np.cumsum([0, *(n for _, n in b)])[:-1].tolist()
            assert sum(n for _, n in b) <= 64 and len(b) <= documents and sum(n * n for _, n in b) <= cost
    hist = Counter(rng.randint(1, 1024) for _ in range(20000))
    _, opened = packing.solve(hist, 1024, 1024, 1 << 20)
    assert opened <= 1.01 * sum(k * n for k, n in hist.items()) / 1024 + 1


def test_packed(spark):
    rng, ids = random.Random(3), reference()
    rows = [(i, " ".join(rng.choice(["alpha", "Beta,", "x1", "été"]) for _ in range(rng.choice([3, 40, 300, 2500])))) for i in range(120)]
    rows += [(600, "a <|endoftext|> b"), (500, None), (501, ""), (502, "same words"), (502, "same words"), (None, "no id")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, piece int, salt string").repartition(3)
    got = packing.packed(df).collect()
    want, bins = Counter(), defaultdict(list)
    for d, t in rows:
        all_ids = ids(t or "") + [2]
        head = len(all_ids) % 1024 or 1024
        cut = [0, *range(head, len(all_ids) + 1, 1024)]
        for i, (a, e) in enumerate(zip(cut, cut[1:])):
            want[d, i, a, e - a, zlib.crc32(np.array(all_ids[a:e], "<u4").tobytes())] += 1
    for r in got:
        want[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] -= 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert not any(want.values())
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *(n for _, n in b)])[:-1].tolist() and sum(n for _, n in b) <= 1024
    plain = []  # best-fit decreasing, one piece at a time
    for n in sorted((r.length for r in got), reverse=True):
        fits = [i for i, x in enumerate(plain) if x + n <= 1024]
        if fits:
            plain[max(fits, key=plain.__getitem__)] += n
        else:
            plain.append(n)
    assert len(bins) == len(plain)
    assert packing.packed(df.limit(0)).collect() == []
    few = packing.packed(df, documents=3, weights=(1.0, 0.02, 0.02)).collect()
    bins = defaultdict(list)
    for r in few:
        bins[r.sequence_id].append(r.length)
    assert sum(map(len, bins.values())) == len(got) and max(map(len, bins.values())) == 3 and max(map(sum, bins.values())) <= 1024
