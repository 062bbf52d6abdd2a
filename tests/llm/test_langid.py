import random
import zlib

import numpy as np

from streamql.llm import langid

SYLLABLES = {"aa": "ka to mi ne ru sha", "bb": "sch ung keit der ein pf", "cc": "ção lh nho ade eza mente"}


def text(lang, rng, n=30):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_grams_by_blocks(monkeypatch):
    t = "Ab c1é  Straße " * 50
    whole = np.sort(np.concatenate(list(langid.grams(t))))
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert np.array_equal(np.sort(np.concatenate(list(langid.grams(t)))), whole)
    for x in ("", " ", "123 $%"):
        assert list(langid.grams(x)) == []
    letters = [x for x in langid.grams("ab")]
    assert len(letters[0]) == 2 + 3 + 2 + 1  # a b, _a ab b_, _ab ab_, _ab_


def test_held_out_accuracy_and_rejection(spark):
    rng = random.Random(6)
    rows = [(i, text(lang := rng.choice(["aa", "aa", "bb", "cc"]), rng, rng.choice([1, 5, 60])), lang if i % 9 else None, lang) for i in range(900)]
    odd = [(2000, None, "aa", ""), (2001, "", "bb", ""), (2002, "12 34!", "cc", ""), (2003, "ka " * 300000, None, "aa"), (None, "der ein keit ung", None, "bb")]
    df = spark.createDataFrame([(*r[:3], "x") for r in rows + odd], "doc_id long, text string, lang string, score string")
    seen = df.where(~langid.held_out(df["doc_id"]))
    model = langid.train(seen, per_lang=150)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    test = [(i, want) for i, _, _, want in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(test) > 150
    assert np.mean([got[i].lang_pred == want for i, want in test]) > 0.95
    taken = [(i, w) for i, w in test if got[i].accepted]
    assert np.mean([got[i].lang_pred == w for i, w in taken]) >= 0.98 and len(taken) > 0.6 * len(test)
    for i in (2000, 2001, 2002):
        assert got[i].lang_pred == "und" and got[i].score == 0
    assert got[2003].lang_pred == "aa" and got[None].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())
    empty = langid.train(df.limit(0))
    assert langid.predict(df, empty).where("lang_pred <> 'und'").count() == 0 and langid.predict(df.limit(0), model).collect() == []


def test_brute_force_scores():
    """Folded or not, a score is the softmax of the averaged embeddings, worked out gram by gram."""
    rng = np.random.default_rng(0)
    for n in (3, langid.FOLDED + 1):
        m = langid.Model([f"l{i:03}" for i in range(n)], rng.normal(size=(langid.BUCKETS, langid.DIM)), rng.normal(size=(langid.DIM, n)), rng.normal(size=n), 1.7)
        for t in ("Ab c", "été 12 x", "word " * 300):
            ids = [int(i) for g in langid.grams(t) for i in g]
            x = sum(m.embeddings[i] for i in ids) / len(ids)
            z = np.array([sum(a * b for a, b in zip(x, m.weights[:, k])) + m.bias[k] for k in range(n)]) / 1.7
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            lang, score, _ = m.predict(t)
            assert lang == m.langs[int(p.argmax())] and abs(score - p.max()) < 1e-4


def test_sample_is_the_smallest_row_hashes(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, text("aa", rng), "aa") for i in range(3000)] + [(i, text("bb", rng), "bb") for i in range(20)]
    df = spark.createDataFrame(rows + rows[:500], "doc_id long, text string, lang string").repartition(7)
    held = []
    monkeypatch.setattr(langid, "fit", lambda samples, names: held.append(samples))
    langid.train(df, per_lang=40)
    hashed = df.selectExpr("xxhash64(doc_id, lang, text) AS u", "text", "lang").distinct().collect()
    want = [sorted((r.u, r.text) for r in hashed if r.lang == x)[:40] for x in ("aa", "bb")]
    texts = [t for _, t in sorted(want[0] + want[1])]
    assert len(held[0]) == 60 and [set(f.tolist()) for _, f, _ in held[0]] == [set(np.concatenate(list(langid.grams(t))).tolist()) for t in texts]
    assert langid._share_end(0) == -(2**63) and langid._share_end(0.5) == 0 and langid._share_end(7) == 2**63 - 1


def test_many_languages_and_repeated_ids(spark):
    rng = random.Random(2)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    langs = {f"l{i:03}": alphabet[3 * i : 3 * i + 3] for i in range(300)}
    say = lambda k: " ".join("".join(rng.choice(langs[k]) for _ in range(3)) for _ in range(8))
    rows = [(10 * i + j, say(k), k) for i, k in enumerate(langs) for j in range(6)]
    rows += [(5, "ka ke ki", "l000")] * 10_000 + [(None, f"ma mo {i}", "zz") for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    held = []
    fit, langid.fit = langid.fit, lambda samples, names: held.append(samples) or fit(samples, names)
    try:
        model = langid.train(df, per_lang=5)
    finally:
        langid.fit = fit
    assert len(model.langs) == 301
    sizes = np.bincount([y for y, _, _ in held[0]])
    assert sizes.max() <= 5 and sizes.min() >= 1 and sizes[-1] == 5
    got = langid.predict(spark.createDataFrame([(i, say(k), k) for i, k in enumerate(langs)], "doc_id long, text string, lang string"), model).collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id:03}" for r in got]) > 0.9
    try:
        langid.train(df, most=100)
        raise AssertionError
    except ValueError:
        pass
