"""A corpus pipeline: each stage takes the documents that the one before kept.

Every stage's documents are written as Parquet to the shared folder and read again, so a lost
executor never costs more than the stage at hand.
"""

from pyspark.sql import DataFrame, SparkSession

from stintlake.llm import mixing, packing, quality, secrets, simhash
from stintlake.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands. Labelled documents among
    those at hand set the limits."""
    limits = quality.fit_limits(docs, table(spark, sf_dir, "labels"))
    return quality.kept_documents(docs, limits)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind of secret."""
    return secrets.redacted_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row for each time that one is taken."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Compression ratios, inferred automata and a tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
