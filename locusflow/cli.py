"""Command line: count reads of BAM or SAM files over an annotation."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from locusflow import __version__
from locusflow.config import CountConfig
from locusflow.plans.count import count_once
from locusflow.plans.output import write_counts, write_details, write_summary
from locusflow.sources.annotation import load_annotation
from locusflow.sources.alignments import detect_paired, read_alignments
from locusflow.sources.samples import parse_sample

log = logging.getLogger("locusflow")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("locusflow", description=__doc__)
    p.add_argument("-V", "--version", action="version", version=f"%(prog)s {__version__}")
    p.add_argument("bams", nargs="+", help="BAM or SAM files, each a path or name=path")
    p.add_argument("-a", "--annotation", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--type", dest="feature_type", default="exon")
    p.add_argument("-g", "--gene-id", dest="gene_attribute", default="gene_id")
    p.add_argument("-f", "--feature-level", action="store_true")
    p.add_argument("-Q", "--min-mapq", type=int, default=0)
    p.add_argument("--primary", action="store_true")
    p.add_argument("--ignore-dup", action="store_true")
    p.add_argument("-p", "--paired", action="store_true")
    p.add_argument("-B", "--both-aligned", action="store_true")
    p.add_argument("-C", "--no-chimeric", action="store_true")
    p.add_argument("-s", "--strand", type=int, default=0)
    p.add_argument("-M", "--multi-mapping", action="store_true")
    p.add_argument("--fraction", action="store_true")
    p.add_argument("-O", "--multi-overlap", action="store_true")
    p.add_argument("--min-overlap", type=int, default=1)
    p.add_argument("--frac-overlap", type=float, default=0.0)
    p.add_argument("--frac-overlap-feature", type=float, default=0.0)
    p.add_argument("--largest-overlap", action="store_true")
    p.add_argument("-t", "--threads", type=int, default=0, help="local cores where no cluster is set; 0: all")
    p.add_argument("-d", "--details", help="write each fragment's outcome to this Parquet folder")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--format", dest="output_format", choices=("featurecounts", "dexseq"), default="featurecounts")
    return p


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    bams, ann_path, out, threads, details, quiet = (args.pop(k) for k in ("bams", "annotation", "output", "threads", "details", "quiet"))
    logging.basicConfig(level=logging.WARNING if quiet else logging.INFO)
    cfg, samples = CountConfig(**args), [parse_sample(b) for b in bams]
    builder = SparkSession.builder.appName("locusflow")
    if threads and SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{threads}]")
    spark = builder.getOrCreate()
    reads = read_alignments(spark, [p for _, p in samples])
    if not cfg.paired and detect_paired(samples[0][1]):
        log.info("paired reads found: counting fragments")
        cfg = cfg.with_(paired=True)
    ann = load_annotation(spark, ann_path, cfg)
    result = count_once(reads, ann.features, ann.chroms, cfg, bool(details))
    shown = " ".join(f'"{x}"' for x in ("-a", ann_path, "-o", out, *(p for _, p in samples)))
    write_counts(result, ann, samples, cfg, out, f"Program:locusflow v{__version__}; Command:{shown} ")
    for status, n, pct in write_summary(spark, result.status, out):
        log.info("%s: %d (%.2f%%)", status, n, pct)
    if details:
        write_details(result, details)
    result.resolved.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
