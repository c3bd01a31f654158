"""Language, quality and toxicity: held-out accuracy, exact search and kernels against brute force, odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteskill.llm import boosted_quality, nearest_toxic, queries, string_kernel

SF = "/root/testdata/sf0.1"
ODD = [(1, None, "x"), (2, "", "x"), (3, "12 34 .,", "x"), (3, "12 34 .,", "x"), (None, "word and word", "x"), (4, "the long word " * 20_000, "x")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string, score string")


def held(rows, labels, column):
    """Answers and predictions of the rows whose labels were not learnt."""
    known = labels.where(F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(F.col(column)).alias("truth"))
    got = rows.where("held_out").join(known, "doc_id").collect()
    assert len(got) > 100
    return got


def test_language_of_held_out_texts(spark):
    rows = queries.op2_string_kernel_language(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows.count() == docs.count()
    got = held(rows, docs, "lang")
    assert np.mean([r["lang_pred"] == r["truth"] for r in got]) > 0.99


@pytest.mark.parametrize(("name", "column", "accuracy", "recall"), [("op4_boosted_quality", "quality", 0.97, 0.97), ("op7_nearest_toxic", "toxic", 0.97, 0.85)])
def test_scores_of_held_out_texts(spark, name, column, accuracy, recall):
    rows = queries.QUERIES[name](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    got = held(rows, spark.read.parquet(f"{SF}/labels.parquet"), column)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == int(r["truth"]) for r in got]) > accuracy
    assert np.mean([r["predicted"] for r in got if int(r["truth"]) == 1]) > recall


def test_kernel_is_the_share_of_common_grams():
    texts = ["the quick brown fox", "der schnelle braune Fuchs", "le renard brun rapide", "the slow brown dog", "ein langsamer Hund", "un chien lent"]
    model = string_kernel.train(texts, ["en", "de", "fr"] * 2, landmarks=6)
    kernel, known = model.kernel(texts)

    def grams(text):
        symbols = [int(model.table[ord(c)]) for c in text.lower()]
        symbols = [s for i, s in enumerate(symbols) if s or not i or symbols[i - 1]]
        return {tuple(symbols[i : i + n]) for n in (1, 2, 3) for i in range(len(symbols) - n + 1)}

    marks = [t for name in ("de", "en", "fr") for t, x in zip(texts, ["en", "de", "fr"] * 2) if x == name]
    for i, j in itertools.product(range(6), range(len(marks))):
        a, b = grams(texts[i]), grams(marks[j])
        assert kernel[i, j] == pytest.approx(len(a & b) / (len(a) * len(b)) ** 0.5, rel=1e-4)
    assert known.all()


def test_language_of_odd_rows(spark):
    text = F.concat_ws(" ", F.array_repeat(F.when(F.col("id") % 2 == 0, "the word of this").otherwise("das Wort von diesem"), (F.col("id") % 7 + 1).cast("int")))
    docs = spark.range(40).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    model = string_kernel.fit(docs, F.lit(True), per_class=10)
    got = sorted(map(str, string_kernel.predict(odd(spark), model).collect()))
    assert len(got) == len(ODD) and sum("'und', score=0.0" in r for r in got) == 4
    assert string_kernel.predict(odd(spark).limit(0), model).collect() == []
    blank = string_kernel.fit(docs, F.lit(False))
    assert {r["lang_pred"] for r in string_kernel.predict(odd(spark), blank).collect()} == {"und"}


def test_trees_walk_like_one_at_a_time():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    forest = boosted_quality.grow(x, y, np.ones(400), trees=20, depth=3)

    def walk(row):
        total = forest.base
        for t in range(len(forest.value)):
            k = 0
            while forest.left[t, k] != k:
                k = forest.left[t, k] if row[forest.feature[t, k]] <= forest.threshold[t, k] else forest.right[t, k]
            total += forest.value[t, k]
        return total

    assert forest.raw(x) == pytest.approx(np.array([walk(r) for r in x]))
    assert np.mean((forest.score(x) > 0.5) == y) > 0.95


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(k, None if k == 9 else k % 2) for k in range(40)] + [(5, 1), (None, 1)], "doc_id bigint, quality int")
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "!!! # #").otherwise("a plain sentence of words.").alias("text"), F.lit(1).alias("label"))
    forest = boosted_quality.fit(docs, labels, least=2.0)
    got = boosted_quality.score(odd(spark), forest).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert boosted_quality.score(odd(spark).limit(0), forest).collect() == []
    unknown = boosted_quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in boosted_quality.score(odd(spark), unknown).collect()} == {0.5}


def test_block_max_search_equals_a_full_scan():
    rng = np.random.default_rng(4)
    idf = np.r_[rng.uniform(1, 5, 30), 1.0]

    def vector():
        terms = sorted(rng.choice(30, rng.integers(1, 6), replace=False).tolist())
        return nearest_toxic.weigh(int(rng.integers(10, 300)), terms, rng.integers(1, 5, len(terms)).tolist(), idf)

    index = nearest_toxic.Index.build([(k, vector(), int(rng.integers(0, 2)), 1.0) for k in range(700)], 31)
    for _ in range(60):
        query = vector()
        near = index.nearest(query, 25.0)
        weights = dict(query)
        every = sorted((-round(sum(w * weights.get(k, 0.0) for k, w in e), 9), i) for i, e in enumerate(index.entries))
        assert [s for s, _ in near] == pytest.approx([-s for s, _ in every[: len(near)]], abs=2e-9)
        held_weight = sum(index.toxic[i] + index.other[i] for _, i in near)
        assert held_weight >= 25 and held_weight - index.toxic[near[-1][1]] - index.other[near[-1][1]] < 25


def test_texts_weighed_together_are_weighed_alone():
    rng = np.random.default_rng(6)
    idf, rows = np.r_[rng.uniform(1, 5, 30), 1.0], [(0, [], []), (4, [], [])]
    for _ in range(40):
        terms = sorted(rng.choice(30, rng.integers(0, 9), replace=False).tolist())
        rows.append((int(rng.integers(0, 60)), terms, rng.integers(1, 5, len(terms)).tolist()))
    cuts = np.cumsum([0] + [len(t) for _, t, _ in rows])
    flat = [np.array([x for r in rows for x in r[k]], np.int32) for k in (1, 2)]
    cuts, keys, weights = nearest_toxic.weigh_all(np.array([r[0] for r in rows]), cuts, *flat, idf)
    for (n, terms, counts), a, z in zip(rows, cuts[:-1], cuts[1:]):
        raw = {t: c**0.5 * idf[t] for t, c in zip(terms, counts)} | ({30: (n - sum(counts)) ** 0.5} if n > sum(counts) else {})
        norm = sum(x * x for x in raw.values()) ** 0.5
        assert keys[a:z].tolist() == list(raw) and weights[a:z] == pytest.approx([x / norm for x in raw.values()], abs=1e-9)
        assert tuple(zip(keys[a:z].tolist(), weights[a:z].tolist())) == nearest_toxic.weigh(n, terms, counts, idf)


def test_toxicity_by_rare_and_short_words(spark):
    # one toxic example in 40 holds a word, of three letters or rare; the others share no word with the text
    rows = [(k, f"zug{'abcde'[k % 5]} filler plain{k}", 0) for k in range(400)] + [(1000 + k, f"oaf{chr(97 + k // 2)} ape word{k}", 1) for k in range(40)]
    rows += [(2000, "qux of nothing", 1), (2001, "an nth remark", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    asked = spark.createDataFrame([(5000, "my qux"), (5001, "an ape there"), (5002, "nth")], "doc_id bigint, text string")
    model, counted = nearest_toxic.fit(docs.select("doc_id", "text").unionByName(asked), docs.select("doc_id", "toxic"), parts=10**9, held=-1)
    assert {"qux", "ape", "oaft", "nth", "filler"} <= set(model.terms) and min(model.idf) > 0
    got = {r["doc_id"]: r for r in nearest_toxic.score(counted, model).where("doc_id >= 5000").collect()}
    assert got[5000]["evidence"][0] == 2000 and got[5002]["evidence"][0] == 2001
    assert got[5001]["score"] > 0.9 and all(1000 <= k < 1040 for k in got[5001]["evidence"])


def test_toxicity_of_odd_rows(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "what a wretched scoundrel").otherwise("what a pleasant evening").alias("text"))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("toxic"))
    model, counted = nearest_toxic.fit(docs.unionByName(odd(spark).select("doc_id", "text")), labels.where("doc_id > 5"))
    got = nearest_toxic.score(counted, model).collect()
    assert len(got) == 60 + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    said = {r["doc_id"]: r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] > 5}
    assert min(s for k, s in said.items() if k % 3 == 0) > 0.9 and max(s for k, s in said.items() if k % 3) < 0.1
    none, counted = nearest_toxic.fit(docs, labels.limit(0))
    assert {r["score"] for r in nearest_toxic.score(counted, none).collect()} == {0.0}
    assert nearest_toxic.score(nearest_toxic.vectors(odd(spark).limit(0), model.terms), model).collect() == []
