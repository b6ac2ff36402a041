"""A training corpus from raw documents: five operators in a row.

Each stage is written as Parquet to the shared folder and read again as the
next one's documents. All stages but the last return the columns of documents;
the last returns every document's shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontam, jaccard, mixing, quality, sharding
from scriptorium.llm.common import scope, stage


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard 0.8 or more."""
    return jaccard.one_of_each(docs, width=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.in_mix_order(docs)


def dealt(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; the slots of a shard follow the mix.

    Parquet promises no order of rows, so the place in the mix is worked out
    again here, from the documents alone, as the stage before did.
    """
    rows = sharding.measured(docs, "source", F.xxhash64(*docs.columns).alias("tie"))
    return sharding.labelled(sharding.dealt(mixing.mixed(rows, tie="tie"), position="position"))


STAGES = [("quality rules", good), ("n-gram Jaccard join", unlike), ("benchmark decontamination", clean), ("source mixing", mixed), ("sharding", dealt)]

#: Components and schedules are iterative; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, apply) in enumerate(STAGES[:-1], 1):
        with scope(spark):  # what the stage wrote for itself goes, its result stays
            docs = stage(apply(spark, docs, sf_dir), f"stage{k}", result=True)
    return STAGES[-1][1](spark, docs, sf_dir)
