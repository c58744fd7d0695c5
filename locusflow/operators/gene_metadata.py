"""What the count tables say of each gene and exon besides its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collapsed_length(features: DataFrame) -> DataFrame:
    """(gene_ord, length): bases that a gene's features cover, overlaps once.

    Touching intervals merge. Contigs are not told apart: intervals of one gene on
    two contigs merge by coordinate, as the count tables define it.
    """
    w = Window.partitionBy("gene_ord").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(w), F.col("start") - 1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start") - 1, reach))
    return features.withColumn("new", new).groupBy("gene_ord").agg(F.sum("new").alias("length"))


def gene_metadata(features: DataFrame) -> DataFrame:
    """(gene_ord, gene_id, chr, starts, ends, strands, length), joined by ';' in feature order."""
    parts = F.array_sort(F.collect_list(F.struct("feature_idx", "chrom", "start", "end", "strand")))
    grouped = features.groupBy("gene_ord", "gene_id").agg(parts.alias("f"))
    joined = lambda name: F.array_join(F.transform("f", lambda x: x[name].cast("string")), ";")
    out = grouped.select("gene_ord", "gene_id", joined("chrom").alias("chr"), joined("start").alias("starts"), joined("end").alias("ends"), joined("strand").alias("strands"))
    return out.join(collapsed_length(features), "gene_ord")


def exon_numbers(features: DataFrame, counts: DataFrame) -> DataFrame:
    """(feature_idx, gene_id, exon_id): exons with any count, numbered per gene in feature order."""
    seen = counts.groupBy(F.col("target").alias("feature_idx")).agg(F.sum("n").alias("n")).where("n > 0").select("feature_idx")
    w = Window.partitionBy("gene_ord").orderBy("feature_idx")
    kept = features.join(seen, "feature_idx", "left_semi")
    return kept.select("feature_idx", "gene_id", F.format_string("E%03d", F.row_number().over(w)).alias("exon_id"))


def count_matrix(targets: DataFrame, counts: DataFrame, samples: list[int]) -> DataFrame:
    """One row per target, one column s<i> per sample; targets without counts have 0."""
    if not samples:
        return targets.select("target")
    wide = counts.groupBy("target").pivot("sample_idx", samples).agg(F.sum("n"))
    wide = wide.select("target", *[F.col(f"`{i}`").alias(f"s{i}") for i in samples])
    return targets.select("target").distinct().join(wide, "target", "left").fillna(0)


def sparse_counts(counts: DataFrame, value) -> DataFrame:
    """(target, counts): the (sample, n) pairs of each target, ``value`` of n as text; one row a target for any number of samples."""
    pairs = F.collect_list(F.struct(F.col("sample_idx").cast("int").alias("sample"), value.alias("n")))
    return counts.groupBy("target").agg(pairs.alias("counts"))
