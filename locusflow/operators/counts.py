"""Weighted counts per target and counts per status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.config import CountConfig
from locusflow.operators.classify import STATUSES

#: Fixed value: fractional counts are whole numbers of millionths.
MICRO = 1_000_000


def count_targets(resolved: DataFrame, cfg: CountConfig) -> DataFrame:
    """(sample_idx, target, n): fragments per target; millionths under ``fraction``.

    A fragment with k targets and NH hits adds 1 to each, or, under ``fraction``,
    1000000 div (NH * k), cut off. Spark sums partially before it shuffles.
    """
    hit = resolved.where(F.col("status") == "Assigned")
    weight = F.expr(f"{MICRO} div greatest(1, nh * size(targets))") if cfg.fraction else F.lit(1)
    # Only reads of several targets need their arrays taken apart.
    target = F.explode("targets") if cfg.multi_overlap else F.get("targets", F.lit(0))
    rows = hit.select("sample_idx", weight.cast("bigint").alias("w"), target.alias("target"))
    return rows.groupBy("sample_idx", "target").agg(F.sum("w").alias("n"))


def count_status(resolved: DataFrame) -> DataFrame:
    """(sample_idx, status, n): reads dropped by a filter, and fragments by outcome, of rows that have both."""
    return resolved.groupBy("sample_idx", "status").agg(F.count("*").alias("n"))


def summary(spark: SparkSession, status: DataFrame) -> DataFrame:
    """The fixed rows of the summary over all samples: ord, status, n, pct."""
    rows = spark.createDataFrame(list(enumerate(STATUSES)), "ord int, status string")
    total = status.groupBy("status").agg(F.sum("n").alias("n"))
    out = rows.join(total, "status", "left").select("ord", "status", F.coalesce("n", F.lit(0)).alias("n"))
    all_n = F.sum("n").over(Window.partitionBy())  # of thirteen rows
    return out.select("ord", "status", "n", F.when(all_n > 0, 100.0 * F.col("n") / all_n).otherwise(F.lit(0.0)).alias("pct"))


def assignment_rate(status: DataFrame) -> DataFrame:
    """(sample_idx, total, assigned, rate) of each sample."""
    got = F.sum(F.when(F.col("status") == "Assigned", F.col("n")).otherwise(0))
    return status.groupBy("sample_idx").agg(F.sum("n").alias("total"), got.alias("assigned")).withColumn("rate", F.when(F.col("total") > 0, F.col("assigned") / F.col("total")).otherwise(F.lit(0.0)))
