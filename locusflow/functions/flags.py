"""Tests on SAM flag bits and strand rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits.
PAIRED = 0x1
UNMAPPED = 0x4
MATE_UNMAPPED = 0x8
REVERSE = 0x10
SECONDARY = 0x100
DUPLICATE = 0x400
SUPPLEMENTARY = 0x800


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def expected_strand(reverse: Column, mode: int) -> Column | None:
    """The strand that a feature must have for a read; None: any."""
    if mode not in (1, 2):
        return None
    same, other = ("-", "+") if mode == 1 else ("+", "-")
    return F.when(reverse, F.lit(same)).otherwise(F.lit(other))


def strand_ok(feature_strand: Column, wanted: list[Column | None]) -> Column:
    """Whether a feature's strand is one of those wanted; '.' always is.

    A read wants one strand, a pair that of either mate (null: no mate).
    """
    if any(w is None for w in wanted):
        return F.lit(True)
    ok = ~feature_strand.isin("+", "-")
    for w in wanted:
        ok = ok | F.coalesce(feature_strand == w, F.lit(False))
    return ok


def clamp_nh(nh: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(65535), F.coalesce(nh, F.lit(1))))
