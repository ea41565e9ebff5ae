"""Five stages from raw documents to a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`. Stages that drop documents judge what their
predecessor kept. Nulls, empty tables and repeated rows: as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm import common, decontaminate, jaccard, langid, mixing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents the quality classifier rejects."""
    return quality.keep_quality(docs, quality.fit(docs, common.table(spark, sf_dir, "labels"), "quality", per_class=2000))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or told with less than half the probability."""
    return langid.keep_language(docs, langid.fit(docs, per_class=500))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by sets of five-word shingles with similarity 0.8 or more, the smallest id stays."""
    return jaccard.keep_one(docs, n=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more is benchmark text."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by source weights; no source more than 1.25 times within as many tokens as come in."""
    return mixing.mix_sources(docs, max_repeats=1.25)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: Models and bisection have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialize(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
