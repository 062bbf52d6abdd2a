import random
from collections import Counter

import corpus_pipeline
from streamql.llm import mixing

from .test_jaccard import brute as brute_near
from .test_substring import brute as brute_substring


def corpus(tmp_path, spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(200):
        t = [word() for _ in range(rng.randint(20, 200))]
        if i % 10 == 0:
            t += passage
        if i % 7 == 0:
            t = [w + "$$$" for w in t]
        rows.append((i, " ".join(t), "en", f"s{i % 3 * i % 3}", 5))
    rows += [(300 + i, rows[i][1], "en", "copy", 5) for i in range(1, 40)] + [(400, None, None, None, None), (401, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = corpus(tmp_path, spark)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    clean = [r for r in rows if r[1] and "$$$" not in r[1]]

    docs = corpus_pipeline.quality_rules(spark, docs, sf)
    assert docs.columns == columns and sorted(docs.collect()) == sorted(clean)

    least = brute_near([r[:2] for r in clean])
    alone = [r for r in clean if least[r[0]] == r[0]]
    docs = corpus_pipeline.near_dedup(spark, spark.createDataFrame(clean, docs.schema), sf)
    assert docs.columns == columns and sorted(docs.collect()) == sorted(alone)

    cut = brute_substring([r[:2] for r in alone])
    docs = corpus_pipeline.substring_dedup(spark, spark.createDataFrame(alone, docs.schema), sf)
    want = sorted((d, " ".join(kept)) for d, _, _, _, kept in cut if kept)
    assert docs.columns == columns and sorted((r.doc_id, r.text) for r in docs.collect()) == want

    plan = {r.doc_id: r.copies for r in mixing.mix_sizes(docs).collect()}
    docs = corpus_pipeline.source_mixing(spark, docs, sf)
    assert docs.columns == columns and Counter(r.doc_id for r in docs.collect()) == Counter({d: n for d, n in plan.items() if n})

    last = corpus_pipeline.best_fit_packing(spark, docs, sf).collect()
    pieces = lambda rows: sorted(tuple(r)[:5] for r in rows)
    assert pieces(corpus_pipeline.run(spark, sf).collect()) == pieces(last)
    assert Counter(r.doc_id for r in last if r.piece == 0) == Counter({d: n for d, n in plan.items() if n})


def test_repeated_ids_and_empty(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    t = "some words of a text that is long enough"
    docs = spark.createDataFrame([(1, t, "en", "a", 1), (1, t, "en", "a", 1), (2, t, "en", "a", 1), (None, t, "en", "a", 1)], schema)
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    rng = random.Random(3)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = lambda: " ".join(f"w{rng.getrandbits(30)}" for _ in range(70))
    shared = text()
    names = "h long, sid long, root long, tiles string, row string, copies long, size long, key string, rate double, piece int, salt long, lost string, kept boolean, x int, words string, m map<string,int>"
    rows = [(i, text() + " " + shared, "en", "s", 5, *([None] * 16)) for i in range(20)] + [(None, None, None, None, None, *([None] * 16)), (3, text(), "en", None, 5, *([None] * 16))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 0
    assert corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path)).count() == len(rows)
