"""From raw documents to a training mix, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which :func:`run` writes as
Parquet to the shared folder and reads again as the next stage's documents. All stages but the
last return the columns of ``documents``; the last one adds the number of the copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.llm import decontamination, mixing, near_dedup, quality, surrogates
from stewardry.llm.common import prepare, store, table

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their rules and come from a host that is not rejected."""
    prepare(spark)
    return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    prepare(spark)
    return near_dedup.keep_one(docs, near_dedup.NearDup(SHINGLE_WORDS, SIMILAR_PERCENT))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows cover less than a twentieth of."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; ``n_chars`` follows the new text."""
    prepare(spark)
    out = surrogates.with_surrogates(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources."""
    prepare(spark)
    return mixing.emit(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

# The surrogates are drawn with keyed digests and checked against each other over the corpus,
# which SQL does not state; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = store(out) if i < len(STAGES) - 1 else out
    return docs
