"""The corpus pipeline: five stages from raw documents to encoded training text.

A stage sees whatever its predecessor kept, in the columns of ``documents``;
others are ignored.  An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keepwell.llm import common, mixing, neardup, piece_codec, pii, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go.

    Null and empty texts have no words and go; a null language or source is a
    value of its own; equal rows share their fate, and each that stays is kept.
    """
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id stays.

    Null and empty texts are copies of each other.  Of several rows with the
    doc_id that stays the smallest in (text, lang, source, n_chars) does; rows
    without a doc_id can't be named as copies and stay.
    """
    return neardup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is masked by its kind, and n_chars counted anew; null texts stay null, all rows stay."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, from not at all to three times.

    Texts without words, null ones too, are never taken.  Null sources form one
    source, the last.  Of equal rows as many are taken as the mix says.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the length and checksum of what they decode to; null and empty texts have no ids, repeated rows each their row."""
    return piece_codec.op7(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mix), ("encoding", encode)]

#: Fingerprint links and best segmentations are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written as a table and read again."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
