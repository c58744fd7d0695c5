"""Options of a counting run, with the checks that a run needs."""

from __future__ import annotations

from dataclasses import dataclass, replace

FORMATS = ("featurecounts", "dexseq")


@dataclass(frozen=True)
class CountConfig:
    """All options of one run.

    ``strand`` 0 is unstranded, 1 stranded, 2 reversely stranded; any other value
    counts as 0. ``bin_width`` is the width of a genome bin of the interval join:
    it changes the plan's cost, never its result.
    """

    feature_type: str = "exon"
    gene_attribute: str = "gene_id"
    feature_level: bool = False
    min_mapq: int = 0
    primary: bool = False
    ignore_dup: bool = False
    paired: bool = False
    both_aligned: bool = False
    no_chimeric: bool = False
    strand: int = 0
    multi_mapping: bool = False
    fraction: bool = False
    multi_overlap: bool = False
    min_overlap: int = 1
    frac_overlap: float = 0.0
    frac_overlap_feature: float = 0.0
    largest_overlap: bool = False
    output_format: str = "featurecounts"
    bin_width: int = 16_384

    def __post_init__(self):
        if self.bin_width < 1:
            raise ValueError("bin_width must be at least 1")
        if self.output_format not in FORMATS:
            raise ValueError(f"output_format must be one of {FORMATS}")
        for name in ("frac_overlap", "frac_overlap_feature"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie between 0 and 1")
        if self.min_mapq < 0 or self.min_overlap < 0:
            raise ValueError("min_mapq and min_overlap must not be negative")
        if self.output_format == "dexseq" and not self.feature_level:
            object.__setattr__(self, "feature_level", True)

    @property
    def strand_mode(self) -> int:
        return self.strand if self.strand in (1, 2) else 0

    @property
    def needs_overlap_length(self) -> bool:
        """Whether any rule looks at how many bases overlap."""
        return self.min_overlap > 1 or self.frac_overlap > 0 or self.frac_overlap_feature > 0 or self.largest_overlap

    def with_(self, **changes) -> CountConfig:
        return replace(self, **changes)
