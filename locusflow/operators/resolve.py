"""Hits of fragments on features, and what each fragment is assigned to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.config import CountConfig
from locusflow.functions import flags as fl
from locusflow.functions.intervals import length, ratio_below, total_overlap
from locusflow.operators.classify import STATUSES
from locusflow.operators.feature_index import resolve_in_rows
from locusflow.operators.interval_join import interval_join
from locusflow.operators.pairing import fragment_key


def candidate_hits(frags: DataFrame, features: DataFrame, cfg: CountConfig, unhit: bool = False) -> DataFrame:
    """(fragment, feature) rows of blocks that overlap strand-compatible features.

    A feature hit by two blocks appears twice; all that follows is by set. With
    ``unhit`` fragments without any hit have rows too, whose target is null.
    Columns: fragment, what it carries, target, overlap (1 where no rule needs it), passed.
    """
    carried = [*fragment_key(cfg), "nh", *[c for c in ("qname", "orphan", "dropped") if c in frags.columns]]
    narrow = ["all_blocks", "read_len"] if cfg.needs_overlap_length else []
    stranded = ["reverse", "mate_reverse"] if cfg.strand_mode else []
    # Outer in either case, so that the blocks are made once; rows without one meet no feature.
    blocks = frags.select(*carried, "chrom", *narrow, *stranded, F.explode_outer("query_blocks").alias("b"))
    left = blocks.select(*carried, "chrom", *narrow, *stranded, F.col("b.start").alias("l_start"), F.col("b.end").alias("l_end"))
    target = F.col("feature_idx") if cfg.feature_level else F.col("gene_ord")
    right = features.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "strand", target.cast("bigint").alias("target"))
    hits = interval_join(left, right, cfg.bin_width, how="left" if unhit else "inner")
    if cfg.strand_mode:
        wanted = [fl.expected_strand(F.col("reverse"), cfg.strand_mode), F.when(F.col("mate_reverse").isNotNull(), fl.expected_strand(F.col("mate_reverse"), cfg.strand_mode))]
        fits = fl.strand_ok(F.col("strand"), wanted)
        hits = hits.withColumn("target", F.when(fits, F.col("target"))) if unhit else hits.where(fits)
    if not cfg.needs_overlap_length:
        return hits.select(*carried, "target", F.lit(1).cast("bigint").alias("overlap"), F.lit(True).alias("passed"))
    hits = hits.withColumn("overlap", total_overlap(F.col("all_blocks"), F.col("r_start"), F.col("r_end")))
    low = F.col("overlap") < cfg.min_overlap
    if cfg.frac_overlap > 0:
        low = low | F.coalesce(ratio_below(F.col("overlap"), F.nullif(F.col("read_len"), F.lit(0)), cfg.frac_overlap), F.lit(True))
    if cfg.frac_overlap_feature > 0:
        low = low | ratio_below(F.col("overlap"), length(F.col("r_start"), F.col("r_end")), cfg.frac_overlap_feature)
    return hits.select(*carried, "target", "overlap", (~low).alias("passed"))


def resolve(frags: DataFrame, features: DataFrame, cfg: CountConfig, unhit: bool = True, index=None, keep: list[str] | None = None) -> DataFrame:
    """One row per fragment: key, nh, status, targets (array), and qname where ``frags`` has it.

    With an ``index``, a broadcast of the features' arrays, each fragment is resolved in its
    own row, and only ``keep`` columns are returned where they are given. Without one its hits are
    joined and grouped. Either way ``unhit`` false leaves out fragments that hit
    nothing, which is all that counts need. Reads that a filter took keep their
    status and are marked ``filtered``.
    """
    if index is None:
        return resolve_joined(frags, features, cfg, unhit)
    return resolve_in_rows(frags, index, cfg, unhit, keep or [*fragment_key(cfg), *(["qname"] if "qname" in frags.columns else [])])


def resolve_joined(frags: DataFrame, features: DataFrame, cfg: CountConfig, unhit: bool) -> DataFrame:
    """Fragments resolved by an interval join whose hits are grouped by fragment, for any number of features.

    What the fragment carries is aggregated with the hits, and its target set is
    bounded by the features at one locus.
    """
    if cfg.paired and cfg.both_aligned:
        frags = frags.withColumn("orphan", F.col("kind") == "orphan")
    if "dropped" in frags.columns:
        frags = frags.withColumn("dropped", F.array_position(F.array(*map(F.lit, STATUSES)), F.col("dropped")).cast("int"))
    hits = candidate_hits(frags, features, cfg, unhit)
    key = [*fragment_key(cfg), *(["qname"] if "qname" in hits.columns else [])]
    hit = F.col("target").isNotNull()
    ok = hit & F.col("passed")
    t = F.when(ok, F.col("target"))
    carried = [F.max(c).alias(c) for c in ("nh", "orphan", "dropped") if c in hits.columns]
    rejected = F.max(F.when(hit & ~F.col("passed"), F.lit(1)).otherwise(F.lit(0))).alias("rejected")
    grouped = hits.groupBy(*key)
    if cfg.multi_overlap and cfg.largest_overlap:
        found = grouped.agg(F.collect_set(F.when(ok, F.struct("overlap", "target"))).alias("h"), rejected, *carried)
        top = F.array_max("h")["overlap"]
        targets = F.array_distinct(F.transform(F.filter("h", lambda x: x["overlap"] == top), lambda x: x["target"]))
    elif cfg.multi_overlap:
        found, targets = grouped.agg(F.collect_set(t).alias("targets"), rejected, *carried), F.col("targets")
    else:
        found = grouped.agg(F.min(t).alias("lo"), F.max(t).alias("hi"), rejected, *carried)
        targets = F.when(F.col("lo").isNull(), F.expr("cast(array() as array<bigint>)")).when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))
    out = found.withColumn("targets", targets)
    n = F.size("targets")
    status = (
        F.when(n == 1, "Assigned").when((n > 1) & F.lit(cfg.multi_overlap), "Assigned").when(n > 1, "Unassigned_Ambiguity")
        .when(F.col("rejected") == 1, "Unassigned_Overlapping_Length").otherwise("Unassigned_NoFeatures")
    )
    if "orphan" in out.columns:
        status = F.when(F.col("orphan"), "Unassigned_Singleton").otherwise(status)
    if "dropped" in out.columns:
        status = F.coalesce(F.get(F.array(*map(F.lit, STATUSES)), F.col("dropped") - 1), status)
    more = [F.col("dropped").isNotNull().alias("filtered")] if "dropped" in out.columns else []
    return out.select(*key, "nh", status.alias("status"), "targets", *more)
