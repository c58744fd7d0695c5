"""CIGAR strings and aligned blocks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = "array<struct<start:bigint,end:bigint>>"


def cigar_blocks(cigar: Column, pos: Column) -> Column:
    """Aligned blocks, 1-based and inclusive, of an alignment at 0-based ``pos``.

    M, =, X and D lengthen the block at hand, N ends it and skips, the other
    operations consume no reference. A null or unparsable CIGAR and a negative
    or null ``pos`` give an empty array.
    """
    cigar = F.coalesce(cigar, F.lit("*"))
    # Without N there is one block at most, and the sum of what consumes reference is all that it takes.
    lengths = F.regexp_extract_all(cigar, F.lit("([0-9]+)[M=XD]"), F.lit(1))
    covered = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    whole = F.filter(F.array(F.struct((pos.cast("bigint") + 1).alias("start"), (pos.cast("bigint") + covered).alias("end"))), lambda b: b["end"] >= b["start"])
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(2))
    lengths = F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(1)), lambda x: x.cast("bigint"))
    steps = F.zip_with(ops, lengths, lambda o, n: F.struct(o.alias("op"), n.alias("n")))
    begin = F.struct(
        (pos.cast("bigint") + 1).alias("at"),
        (pos.cast("bigint") + 1).alias("open"),
        F.expr(f"cast(array() as {BLOCKS})").alias("done"),
    )

    def closed(acc: Column) -> Column:
        block = F.struct(acc["open"].alias("start"), (acc["at"] - 1).alias("end"))
        return F.when(acc["at"] > acc["open"], F.concat(acc["done"], F.array(block))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        after = acc["at"] + x["n"]
        grow = F.struct(after.alias("at"), acc["open"].alias("open"), acc["done"].alias("done"))
        skip = F.struct(after.alias("at"), after.alias("open"), closed(acc).alias("done"))
        return F.when(x["op"].isin("M", "=", "X", "D"), grow).when(x["op"] == "N", skip).otherwise(acc)

    blocks = F.when(F.contains(cigar, F.lit("N")), F.aggregate(steps, begin, step, closed)).otherwise(whole)
    return F.when(pos >= 0, blocks).otherwise(F.expr(f"cast(array() as {BLOCKS})"))


def blocks_length(blocks: Column) -> Column:
    """Sum of the blocks' lengths (deletions count, insertions and clips do not)."""
    return F.aggregate(blocks, F.lit(0).cast("bigint"), lambda a, b: a + b["end"] - b["start"] + 1)
