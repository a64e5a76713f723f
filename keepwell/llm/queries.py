"""The registered queries of the llm operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keepwell.llm import common, language_id, lm_scoring, media, mixing, neardup, piece_codec, pii, quality_classifier, quality_rules, token_counts


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(common.documents(spark, sf_dir), common.labels(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op2(common.documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op3(common.documents(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(common.documents(spark, sf_dir))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op5(common.documents(spark, sf_dir))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op6(common.documents(spark, sf_dir))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.op7(common.documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9(common.documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(common.documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_pii": op2_pii,
        "op3_quality_rules": op3_quality_rules,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_neardup": op5_neardup,
        "op6_media": op6_media,
        "op7_piece_codec": op7_piece_codec,
        "op8_token_counts": op8_token_counts,
        "op9_mixing": op9_mixing,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": mixing.ORACLE}
