"""Interval-overlap join as an equi-join on genome bins of several widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of two neighbouring classes of intervals differ by this factor; so many classes hold intervals of any length.
STEP, CLASSES = 8, 15


def length_class(start: Column, end: Column, width: int) -> Column:
    """The first class whose bins are as wide as [start, end] is long: ``width``, then STEP times as much each."""
    size, out = end - start + 1, F.lit(CLASSES - 1)
    for k in range(CLASSES - 2, -1, -1):
        out = F.when(size <= width * STEP**k, k).otherwise(out)
    return out


def _bins_of_class(k: int, wide: int) -> Column:
    """Bins in which intervals of a class begin that may overlap [l_start, l_end]."""
    every = F.sequence(F.floor((F.col("l_start") - wide + 1) / F.lit(wide)), F.floor(F.col("l_end") / F.lit(wide)))
    return F.transform(every, lambda b: F.struct(F.lit(k).alias("k"), b.alias("b")))


def interval_join(left: DataFrame, right: DataFrame, width: int, chrom: str = "chrom", how: str = "inner") -> DataFrame:
    """Pairs of rows of ``left`` (l_start, l_end) and ``right`` (r_start, r_end) that overlap.

    Both sides have ``chrom``; bounds are inclusive, and rows that end before they start
    overlap nothing. A right row is held once, in the bin of its start among those of its
    class, so long ones are not copied. What overlaps a left row begins at most a bin's width before it, so
    a left row looks up the bins from there on, mostly two for each class that ``right``
    has; which these are takes a pass over its lengths. No pair is found twice. With ``how``
    "left" every bin of a left row without partner there gives a row of nulls.
    The join key (chrom, class, bin) lets Spark broadcast a small side by its
    measured size, or sort-merge two large ones and split skewed bins.
    """
    kept = right.where("r_start <= r_end").withColumn("_class", length_class(F.col("r_start"), F.col("r_end"), width))
    present = sorted(r[0] for r in kept.select("_class").distinct().collect()) or [0]  # CLASSES numbers at most
    wide = F.element_at(F.array(*[F.lit(width * STEP**k) for k in range(CLASSES)]), F.col("_class") + 1)
    held = kept.select(F.col(chrom).alias("_chrom"), "_class", F.floor(F.col("r_start") / wide).alias("_bin"), *[c for c in right.columns if c != chrom])
    bins = [_bins_of_class(k, width * STEP**k) for k in present]
    # The outer form in either case: for the other Spark adds a filter that makes the array twice.
    asked = left.withColumn("_at", F.explode_outer(F.when(F.col("l_start") <= F.col("l_end"), F.concat(*bins))))
    same = (F.col(chrom) == F.col("_chrom")) & (F.col("_at.k") == F.col("_class")) & (F.col("_at.b") == F.col("_bin"))
    hit = (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end"))
    return asked.join(held, same & hit, how).drop("_at", "_chrom", "_class", "_bin")
