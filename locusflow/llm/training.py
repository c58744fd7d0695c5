"""Labelled training rows: a bounded, repeatable sample and its texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.common import cut


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m``; of the empty text where null."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def sample_texts(docs: DataFrame, marks: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """(doc_id, y, text) of at most ``most`` labelled documents, chosen by hash of the id among those that ``train`` allows.

    Ids without label or with two different ones are left out; without any label
    there are no rows. Of several rows of one id the text with the least hash is
    taken, so there are at most ``most`` rows, however many an id has. The chosen
    ids, and the hashes of their texts, are at most ``most`` numbers and broadcast.
    """
    ids = marks.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    chosen = cut(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.col("y").cast("int").alias("y")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), "doc_id")
    least = cut(rows.groupBy("doc_id").agg(F.min("h").alias("h")))
    return rows.join(F.broadcast(least), ["doc_id", "h"]).select("doc_id", "y", "text").distinct()
