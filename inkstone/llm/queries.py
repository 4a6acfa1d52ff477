"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_main_text, importance_planes, language_crf, license_scan, near_dedup, packing, quality_gam, quality_rules, secret_cnn, shared_search, toxicity_chain
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SEQUENCE_TOKENS = 2048
END_ID = 0


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, SEQUENCE_TOKENS, END_ID)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_chain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.resolve(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main_text.extract(table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_cnn.scan(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_planes.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ALL = (
    op1_best_fit_packing,
    op2_bpe_round_trip,
    op3_toxicity_chain,
    op4_near_dedup,
    op5_license_scan,
    op6_exact_dedup,
    op7_quality_rules,
    op8_language_crf,
    op9_html_extraction,
    op10_quality_classifier,
    op11_secret_scan,
    op12_ranked_search,
    op13_importance_resampling,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.ORACLE_SQL, "op12_ranked_search": shared_search.ORACLE_SQL, "op13_importance_resampling": importance_planes.ORACLE_SQL}
