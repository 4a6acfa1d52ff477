"""The pipeline against a plain version of its stages."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkstone.llm import near_dedup, quality_gam, quality_rules
from inkstone.llm.common import settle

from .test_operators import LOWER, brute_base, brute_classes


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What goes into and comes out of each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
        held.append(docs)
    return held


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "exact_dedup", "near_dedup", "best_fit_packing"]


def test_filters_agree_with_the_operators(spark, sf_dir, stages):
    judged = quality_rules.judge(stages[0])
    assert ids(stages[1]) == ids(judged.where("kept"))
    for r in stages[0].collect():
        n, _, _, _, repeated = brute_base(r.text)
        if n < 50 or 100 * repeated > 50 * n:
            assert r.doc_id not in ids(judged.where("kept"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_gam.classify(stages[1], labels)
    assert ids(stages[2]) == ids(scored.where(F.col("predicted") == 1))


def test_filters_keep_clean_documents(sf_dir, stages):
    good = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{sf_dir}/labels.parquet' JOIN '{sf_dir}/documents.parquet' USING (doc_id) WHERE quality = 1").fetchall()}
    long_enough = {r.doc_id for r in stages[0].collect() if brute_base(r.text)[0] >= 50} & good
    assert len(long_enough & ids(stages[2])) > 0.95 * len(long_enough)


def test_dedup_stages_equal_brute_force(stages):
    best = {}
    for r in stages[2].collect():
        key = r.text.translate(LOWER)
        best[key] = max(best.get(key, -1), r.doc_id)
    assert ids(stages[3]) == set(best.values())
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    assert ids(stages[4]) == set(brute_classes(texts).values())


def test_all_that_is_kept_is_packed(stages):
    packed = stages[5].toPandas()
    assert set(packed["doc_id"]) == ids(stages[4])
    fill = packed.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 2048 and len(fill) <= -(-int(fill.sum()) // 2048) + 2


def test_stages_keep_all_columns(stages):
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:5])


def test_run(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.select("doc_id", "piece", "ids_crc32").exceptAll(stages[5].select("doc_id", "piece", "ids_crc32")).count() == 0


def test_workers_keep_few_words_and_rows():
    """An executor keeps several workers, and what each holds on to counts there."""
    words = [f"w{k}" for k in range(100_000)]
    whole, counts = near_dedup.shingles(words)
    assert len(near_dedup._hash) <= near_dedup.HASHED_WORDS <= 50_000
    assert corpus_pipeline.BATCH_ROWS <= 250 and near_dedup.RUN_WORDS <= 100_000
    again, _ = near_dedup.shingles(words)  # words that were dropped meanwhile get the same hash
    assert len(whole) == 99_996 and (counts == 1).all() and (whole == again).all()
