import random
import re
import time

from pyspark.sql import functions as F

from streamql.llm import licenses
from streamql.llm.license_rules import BASE, GATE_WORDS, RULES, fixed_words, keyword_of

TEXTS = [
    None, "", "   ", "Nothing to see.", "CC BY CC-BY cc/by", "xcc by", "All rights\nreserved. all RIGHTS reserved!",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "SPDX-License-Identifier: Apache-2.0", "General Publik license, Kelvin CC BY",
    "ccéby general public\tlicense " * 3, "word " * 5000 + "all rights reserved", "Copyright (c) 2019 Someone. All rights reserved.",
]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), sorted({label for _, label in at})


def places(text):
    """All places by every rule, one rule after the other, then settled one by one."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    norm, found = " " + " ".join(words) + " ", []
    for i, (label, _, pattern, relevance) in enumerate(RULES):
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", norm):
            first = norm[: m.start()].count(" ") - 1
            found.append((first, -(first + m[0].count(" ")), i, label, relevance))
    kept = []
    for p in sorted(found):
        if not kept or p[0] > -kept[-1][1]:
            kept.append(p)
        elif p[1] < kept[-1][1] and p[2] < kept[-1][2]:
            kept[-1] = p
    return [(f, -e, i, label, x) for f, e, i, label, x in kept]


def sample(pattern, rng):
    """A text that the pattern matches."""
    while "(" in pattern:
        m = re.search(r"\(\?:([^()]*)\)(\?)?", pattern)
        pattern = pattern[: m.start()] + ("" if m[2] and rng.random() < 0.5 else rng.choice(m[1].split("|"))) + pattern[m.end() :]
    pattern = re.sub(r"\[(.)([^]]*)\](\{[^}]*\})?", lambda m: "aa" if m[1] == "a" and "-z" in m[2] else m[1] if m[1] not in "0" else "1", pattern)
    return re.sub(r"(.)\?", lambda m: rng.choice(["", m[1]]), pattern)


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, scan string")
    return {r.doc_id: r.scan for r in licenses.scan(df).collect()}


def test_base_columns(spark):
    got = scanned(spark, TEXTS)
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, list(got[i].base_labels)) == base(t), t
        assert set(got[i].base_labels) <= set(got[i].labels) and 0 <= got[i].score <= 1


def test_rules_and_suppression(spark):
    got = scanned(spark, TEXTS)
    label = {t: got[i].labels for i, t in enumerate(TEXTS)}
    assert label["Licensed under the Apache License, Version 2.0."] == ["apache-2.0"]
    assert label["Licensed under CC BY-NC 4.0."] == ["cc-by", "cc-by-nc-4.0"]
    assert label["Released under the MIT License."] == ["mit"]
    assert label["SPDX-License-Identifier: Apache-2.0"] == ["apache-2.0"]
    assert label["This work is licensed under the GNU General Public License, version 3."] == ["gpl", "gpl-3.0"]
    for s in got.values():
        for a, b in zip(s.places, s.places[1:]):
            assert a.last < b.first


def test_rules_are_well_formed():
    assert len(RULES) >= 500 and len({(r[0], r[2]) for r in RULES}) == len(RULES)
    for label, keyword, pattern, relevance in RULES:
        re.compile(pattern)
        assert 0 < relevance <= 1 and label == label.lower() and keyword == keyword_of(pattern)
        assert any(g in run for run in fixed_words(pattern) for g in GATE_WORDS) or "cc by" in pattern, pattern


def test_every_rule_matches_and_is_gated_by_its_keyword(spark):
    rng = random.Random(4)
    texts = []
    for label, keyword, pattern, _ in RULES:
        for _ in range(3):
            t = sample(pattern, rng)
            assert re.fullmatch(pattern, t), (pattern, t)
            assert keyword in t
        texts.append(rng.choice(["", "some words "]) + t.upper() + rng.choice(["", "\n(and more)"]))
    texts += [f"{a} {rng.choice(['', 'x '])}{b}" for a, b in zip(texts, rng.sample(texts, len(texts)))][:300] + TEXTS
    texts += ["GNU General Public License version 2 or later or later", "spdx license identifier gpl 2 0 only apache 2 0", "creative commons attribution share alike 4 0 creative commons"] * 2
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        want = places(t)
        assert [tuple(p) for p in got[i].places] == want, t
        assert list(got[i].labels) == sorted({p[3] for p in want} | set(base(t)[4]))
        assert got[i].score == max([0.8 if base(t)[1] else 0.0, *(p[4] for p in want)])


def test_repeated_rows_null_ids_and_very_many_places(spark):
    long = "released under the mit license and copyright 2019 all rights reserved " * 60_000
    rows = [(1, "bsd license"), (1, "bsd license"), (None, "isc license"), (None, None), (2, long)]
    began = time.time()
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size("scan.places").alias("n"), "scan.labels", "scan.n_base").collect()
    assert sorted((str(r.doc_id), r.n, ",".join(r.labels), r.n_base) for r in got) == [("1", 1, "bsd", 0), ("1", 1, "bsd", 0), ("2", 120_000, "copyright,mit,reserved", 60_000), ("None", 0, "", 0), ("None", 1, "isc", 0)]
    assert time.time() - began < 60


def test_chains_of_overlapping_places(spark):
    """Long chains, as no text is known to hold, against the plain sweep."""
    rng, rows, want = random.Random(7), [], []
    for n in (1, 2, 300, 3000):
        found = sorted({(a := rng.randint(0, 3 * n) if n < 300 else 2 * i, -(a + rng.randint(0, 4 if n < 300 else 3)), rng.randint(0, 9)) for i in range(n)})
        rows.append((n, [(f, e, p, f"l{p}", 0.5) for f, e, p in found]))
        kept = []
        for p in found:
            if not kept or p[0] > -kept[-1][1]:
                kept.append(p)
            elif p[1] < kept[-1][1] and p[2] < kept[-1][2]:
                kept[-1] = p
        want.append((n, kept))
    df = spark.createDataFrame(rows, f"n int, found array<{licenses.PLACE}>")
    got = df.select("n", licenses._settled(F.col("found")).alias("kept")).collect()
    assert sorted((r.n, [(p["first"], p.ending, p.priority) for p in r.kept]) for r in got) == want


def test_filter_on_result_and_empty(spark):
    df = spark.createDataFrame([(1, "all rights reserved")], "doc_id long, text string")
    assert licenses.scan(df).filter(F.size("scan.labels") > 0).count() == 1
    assert licenses.scan(df.limit(0)).collect() == []
