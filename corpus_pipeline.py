"""A pipeline over ``documents``: quality, exact duplicates, near duplicates, mix, tokens.

Each stage gets what the one before it kept, as a table read from Parquet, and acts on all of it. All but the last return the
columns of ``documents``; the last returns them without the text, with the token ids and the bytes that these decode to.

Cases: the stages take over those of their operators (see quarry.llm): null and empty texts are scored by the classifier's
bias, are equal to each other as duplicates, have no words to mix and so leave the corpus in the mix; a table that is empty or
becomes empty gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, exact_dedup, mixing, quality, similar
from quarry.llm.common import materialise, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: texts at least 0.8 similar in their five-word shingles, and what these lead to."""
    return similar.drop_similar(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times; those it takes less than half of go."""
    return mixing.apply_mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, and the bytes they decode to."""
    return bpe.encode_and_decode(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix", mix_stage),
    ("bpe", encode_stage),
]

#: SQL can't express the classifier, the fingerprints and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
