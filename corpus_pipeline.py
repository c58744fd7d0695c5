"""A corpus from raw documents to shards: five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from locusflow.llm.common import remove, scratch, shared_dir
from locusflow.llm.decontaminate import benchmark, without_leaks
from locusflow.llm.mixing import take_documents
from locusflow.llm.quality import reject_low_quality
from locusflow.llm.sharding import assign_shards
from locusflow.llm.simhash import keep_one
from locusflow.llm.training import labels


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees do not reject."""
    return reject_low_quality(docs, labels(spark, sf_dir))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group; of several texts of that id, one."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return without_leaks(docs, benchmark(spark, sf_dir))


def mix_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return take_documents(docs)


def virtual_slot_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return assign_shards(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mix_to_target_weights),
    ("sharding", virtual_slot_sharding),
]
#: SQL has neither the trees nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder before the next reads it.

    What a stage wrote for itself, and the documents of the stage before, go once it is written.
    An empty table gives an empty one; null, empty and repeated texts are treated as each stage says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}")
        docs = spark.read.parquet(f"{top}/{i}")
        remove(spark, f"{top}/{i - 1}")
    return docs
