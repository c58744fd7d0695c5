"""Count tables and summaries as files."""

from __future__ import annotations

import gzip
import json
import os
from collections.abc import Iterable
from contextlib import nullcontext
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.config import CountConfig
from locusflow.operators.counts import MICRO, summary
from locusflow.operators.gene_metadata import exon_numbers, gene_metadata, sparse_counts
from locusflow.plans.count import CountResult
from locusflow.sources.annotation import Annotation
from locusflow.sources.bam import open_output
from locusflow.sources.line_sink import TableSink


def _write(path: str, lines: Iterable[str]) -> None:
    with open_output(path) as raw, gzip.GzipFile(fileobj=raw, mode="wb") if path.endswith(".gz") else nullcontext(raw) as f:
        for part in batched(lines, 1000):
            f.write("".join(x + "\n" for x in part).encode())


def table(result: CountResult, ann: Annotation, cfg: CountConfig) -> DataFrame:
    """The count table, in output order by ``ord``: what a line begins with, and the samples that have counts.

    Its plan is the same for any number of samples, and a row holds no more than the counts there are.
    """
    if not cfg.feature_level:
        base = ann.genes.join(gene_metadata(ann.features).drop("gene_id"), "gene_ord").withColumn("target", F.col("gene_ord"))
        cols = ["gene_id", "chr", "starts", "ends", "strands", F.col("length").cast("string")]
    elif cfg.output_format == "dexseq":
        base = ann.features.join(exon_numbers(ann.features, result.counts).drop("gene_id"), "feature_idx").withColumn("target", F.col("feature_idx"))
        cols = ["gene_id", F.concat_ws(":", "gene_id", "exon_id")]
    else:
        base = ann.features.withColumn("target", F.col("feature_idx"))
        cols = ["gene_id", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "strand", (F.col("end") - F.col("start") + 1).cast("string")]
    value = F.format_string("%.6f", F.col("n").cast("double") / MICRO) if cfg.fraction else F.col("n").cast("string")
    return base.join(sparse_counts(result.counts, value), "target", "left").select(F.col("target").alias("ord"), F.array(*cols).alias("fields"), "counts")


def write_counts(result: CountResult, ann: Annotation, samples: list[tuple[str, str]], cfg: CountConfig, path: str, command: str) -> None:
    """One tab-separated file, gzipped where its name ends in .gz, written by the executors in ranges of its lines."""
    names = [n for n, _ in samples]
    if cfg.output_format == "dexseq":
        head = ["\t".join(["gene_id", "exon_id", *names])]
    else:
        head = [f"# {command}", "\t".join(["Geneid", "Chr", "Start", "End", "Strand", "Length", *names])]
    rows = table(result, ann, cfg)
    rows.sparkSession.dataSource.register(TableSink)
    lines = rows.repartitionByRange("ord").sortWithinPartitions("ord").select("fields", "counts")
    options = {"head": json.dumps(head), "samples": len(names), "zero": "0.000000" if cfg.fraction else "0"}
    lines.write.format("count_table").options(**options).mode("append").save(path)


def summary_path(path: str) -> str:
    """The counts' path with its last extension replaced."""
    return os.path.splitext(path)[0] + ".summary"


def write_summary(spark, status: DataFrame, path: str) -> list[tuple[str, int, float]]:
    rows = [(r.status, r.n, r.pct) for r in summary(spark, status).orderBy("ord").collect()]
    _write(summary_path(path), ["Status\tCount\tPercentage", *(f"{s}\t{n}\t{p:.2f}%" for s, n, p in rows)])
    return rows


def write_details(result: CountResult, path: str) -> None:
    """Each fragment with its status and targets, as Parquet."""
    result.resolved.where("not filtered").drop("filtered").write.mode("overwrite").parquet(path)
