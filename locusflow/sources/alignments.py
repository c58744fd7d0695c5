"""Alignments for counting from files of either format, told by their first bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions.cigar import cigar_blocks
from locusflow.sources import bam, sam


def read_alignments(spark: SparkSession, paths: list[str], split_bytes: int = 64 << 20) -> DataFrame:
    """What counting reads of all ``paths``, each a sample, numbered in their order."""
    text = [i for i, p in enumerate(paths) if sam.is_sam(p)]
    packed = [i for i in range(len(paths)) if i not in set(text)]
    parts = []
    if packed:
        rows = bam.read_bam(spark, [paths[i] for i in packed], split_bytes, bam.COUNT_FIELDS)
        number = F.get(F.array(*map(F.lit, packed)), F.col("sample_idx"))
        parts.append(rows if packed == list(range(len(packed))) else rows.withColumn("sample_idx", number))
    if text:
        rows = sam.read_sam(spark, [paths[i] for i in text], samples=text)
        parts.append(rows.withColumn("blocks", cigar_blocks(F.col("cigar"), F.col("pos"))).select(*bam.COUNT_FIELDS))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def detect_paired(path: str, n: int = 1000) -> bool:
    """Whether any of the first ``n`` records of a file has the paired flag; only the head of the file is read."""
    return (sam if sam.is_sam(path) else bam).detect_paired(path, n)
