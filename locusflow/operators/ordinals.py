"""Row numbers in a global order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.sources.shared import written


def with_ordinal(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``rows`` with ``name``, from 0 on in the order of ``order``.

    Rows are dealt by ranges of the order and sorted there, and the result is written, so
    that the numbers inside the ranges and the counts of the ranges are of one dealing. A range starts
    where the ones before it end, a number a range. Equal rows are numbered in any order.
    """
    at = F.monotonically_increasing_id()  # range << 33, and the row's place in it
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    starts, before = {}, 0
    for r in sorted(dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()):  # a row a partition
        starts[r["_range"]], before = before, before + r.n
    begins = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in starts.items() for x in pair]), F.col("_range")) if starts else F.lit(0)
    return dealt.withColumn(name, begins + F.col("_at")).drop("_range", "_at")
