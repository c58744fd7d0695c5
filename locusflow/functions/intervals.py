"""Arithmetic of 1-based inclusive intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(start: Column, end: Column) -> Column:
    return end - start + 1


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def total_overlap(blocks: Column, start: Column, end: Column) -> Column:
    """Bases of all ``blocks`` inside [start, end]; blocks that overlap each other count twice."""
    return F.aggregate(blocks, F.lit(0).cast("bigint"), lambda a, b: a + overlap_length(b["start"], b["end"], start, end))


def ratio_below(part: Column, whole: Column, threshold: float) -> Column:
    """part/whole < threshold in single precision, as thresholds are given in it."""
    return (part.cast("double") / whole.cast("double")).cast("float") < F.lit(threshold).cast("float")
