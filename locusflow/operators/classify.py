"""The ordered chain of read filters: the first that matches names the status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.config import CountConfig
from locusflow.functions import flags as fl

#: Contigs that executors are sent at most, each a name.
MOST_CONTIGS = 500_000
# Rows of the summary, in their order.
STATUSES = (
    "Assigned",
    "Unassigned_Unmapped",
    "Unassigned_Read_Type",
    "Unassigned_Singleton",
    "Unassigned_MappingQuality",
    "Unassigned_Chimera",
    "Unassigned_FragmentLength",
    "Unassigned_Duplicate",
    "Unassigned_MultiMapping",
    "Unassigned_Secondary",
    "Unassigned_NoFeatures",
    "Unassigned_Overlapping_Length",
    "Unassigned_Ambiguity",
)


def classify(alignments: DataFrame, chroms: DataFrame, cfg: CountConfig) -> DataFrame:
    """Add ``status`` (null: the read goes on) and, for paired runs, ``solo``.

    ``solo`` marks reads whose mate is unmapped: they count alone, at once.
    ``chroms`` has each contig of the annotation once. They are counted, and broadcast if they
    are MOST_CONTIGS at most: Spark's own guess rests on the annotation's size and
    might shuffle the reads by contig.
    """
    f, nh = F.col("flags"), fl.clamp_nh(F.col("nh"))
    sent = F.broadcast if chroms.limit(MOST_CONTIGS + 1).count() <= MOST_CONTIGS else lambda x: x
    known = sent(chroms.select(F.col("chrom").alias("_known")))
    out = alignments.join(known, F.col("chrom") == F.col("_known"), "left")
    rules: list[tuple[Column, str]] = [(fl.has(f, fl.UNMAPPED), "Unassigned_Unmapped")]
    if cfg.primary:
        rules.append((fl.has(f, fl.SECONDARY) | fl.has(f, fl.SUPPLEMENTARY), "Unassigned_Secondary"))
    if cfg.min_mapq > 0:
        rules.append((F.col("mapq") < cfg.min_mapq, "Unassigned_MappingQuality"))
    if cfg.ignore_dup:
        rules.append((fl.has(f, fl.DUPLICATE), "Unassigned_Duplicate"))
    if not cfg.multi_mapping:
        rules.append((nh > 1, "Unassigned_MultiMapping"))
    rules.append((F.col("_known").isNull(), "Unassigned_NoFeatures"))
    solo = fl.has(f, fl.MATE_UNMAPPED)
    if cfg.paired:
        if cfg.both_aligned:
            rules.append((solo, "Unassigned_Singleton"))
        if cfg.no_chimeric:
            mates = sent(chroms.select(F.col("chrom").alias("_mate_known")))
            out = out.join(mates, F.col("mate_chrom") == F.col("_mate_known"), "left")
            far = F.col("_mate_known").isNotNull() & (F.col("mate_chrom") != F.col("chrom"))
            rules.append((~solo & far, "Unassigned_Chimera"))
    status = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        status = F.when(condition, F.lit(name)).otherwise(status)
    return out.withColumns({"status": status, "solo": solo, "nh": nh}).drop("_known", "_mate_known")
