"""The pipeline stage by stage against decisions made by hand from the stage's own input."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from siteskill.llm import boosted_quality, gumbel_pieces
from siteskill.llm.texts import BATCH_BYTES
from siteskill.session import stage

from .test_text_operators import SF, brute_components


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, step in corpus_pipeline.STAGES:
        tables.append(stage(step(spark, tables[-1], SF), name))
    start, good, ruled, single, mixed, encoded = (t.collect() for t in tables)
    assert all(t.columns == docs.columns for t in tables[:-1])
    assert {r.doc_id for r in start} > {r.doc_id for r in good} >= {r.doc_id for r in ruled} >= {r.doc_id for r in single}
    assert len(good) > len(start) / 2 and len(ruled) > len(good) / 2
    groups = brute_components([(r.doc_id, r.text) for r in ruled])
    assert sorted(r.doc_id for r in single) == sorted({c for _, _, c in groups})
    size = sum(len((r.text or "").split()) for r in single)
    assert abs(sum(len((r.text or "").split()) for r in mixed) - 1.5 * size) < 0.1 * size
    assert sorted(r.doc_id for r in encoded) == sorted(r.doc_id for r in mixed)
    vocab, text = gumbel_pieces.vocabulary(), {r.doc_id: r.text for r in single}
    assert all(gumbel_pieces.decoded(s, vocab) == text[r.doc_id] for r in encoded for s in r.segmentations)


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, rank string, copies int, score double, kept boolean, failed int"


def test_stages_judge_rows_and_not_ids(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    good, other, bad = text(60), text(70), "bad " * 100
    rows = [(k, t, "en", "s", len(t or ""), 1, "r", 2, 0.5, True, 3) for k, t in [
        (None, bad), (1, bad), (2, good), (2, bad), (2, good), (None, good + " end"), (3, other), (None, other), (4, None), (None, "")]]
    docs = spark.createDataFrame(rows, ODD)
    tell = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    ruled = corpus_pipeline.rules(spark, docs, SF)
    assert tell(ruled) == Counter({(2, good): 2, (None, good + " end"): 1, (3, other): 1, (None, other): 1})
    single = corpus_pipeline.near_duplicates(spark, stage(ruled, "odd_ruled"), SF)
    assert tell(single) == Counter({(2, good): 1, (3, other): 1})
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert set(tell(mixed)) <= set(tell(docs)) and mixed.count() > 0
    assert all(r.size == 1 and r.rank == "r" and r.copies == 2 for r in mixed.collect())
    scored = corpus_pipeline.quality(spark, docs, SF)
    for name, df in (("rules", ruled), ("join", single), ("mix", mixed), ("quality", scored)):
        assert df.columns == docs.columns, name
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    forest = boosted_quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    bound = sorted(forest.score(boosted_quality.matrix([r[1] for r in rows])))[5]
    kept = boosted_quality.good(docs, forest, bound)
    want = Counter((r[0], r[1]) for r, s in zip(rows, forest.score(boosted_quality.matrix([r[1] for r in rows]))) if s >= bound)
    assert tell(kept) == want and kept.columns == docs.columns


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs, SF).collect() == [], name


def _weighed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])


@pytest.mark.parametrize("step", [corpus_pipeline.rules, corpus_pipeline.near_duplicates, corpus_pipeline.encode])
def test_texts_reach_workers_in_batches_of_a_few_mb(spark, step):
    own = spark.conf.get(BATCH_BYTES, None)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("twelve bytes"), 500).alias("text"))
    try:
        spark.conf.unset(BATCH_BYTES)
        step(spark, docs.limit(1), SF)
        sizes = docs.mapInArrow(_weighed, "n bigint, size bigint").collect()
        assert sum(r.n for r in sizes) == 3000 and max(r.size for r in sizes) < 5_000_000
        spark.conf.set(BATCH_BYTES, "9000000")
        step(spark, docs.limit(1), SF)
        assert spark.conf.get(BATCH_BYTES) == "9000000"
    finally:
        if own is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, own)
