"""Warm wall time of the headline counting queries; prints one JSON line.

``queries`` make their reads from the tables first, as in every round. ``prepared`` has
the counting alone, over reads that lie in Parquet, and ``bam`` the decoding of BAM files.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from locusflow.config import CountConfig
from locusflow.plans import catalog, fixtures
from locusflow.plans.count import count_reads
from locusflow.sources.bam import COUNT_FIELDS, Range, read_bam, read_range

HEADLINE = ("gene_counts_single", "gene_counts_paired", "stranded_paired", "largest_overlap", "frac_overlap_paired", "fractional_multi_overlap", "feature_counts_multi", "status_summary_paired", "interval_join_hits", "mate_pairing")


def warm(df) -> float:
    """Seconds of the second of two runs."""
    for _ in range(2):
        t = time.perf_counter()
        df().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - t
    return round(took, 3)


def prepared(spark, d) -> dict[str, float]:
    path, ann = tempfile.mkdtemp(prefix="spark-bench-"), fixtures.annotation(spark, d)
    fixtures.alignments(spark, d).write.mode("overwrite").parquet(path)
    reads = spark.read.parquet(path)
    return {f"{name}_{what}": warm(lambda c=cfg, w=what: getattr(count_reads(reads, ann.features, ann.chroms, c), w)) for name, cfg in (("single", CountConfig()), ("paired", CountConfig(paired=True))) for what in ("counts", "status")}


def decoding(spark, d, reads: int) -> dict[str, float]:
    paths = fixtures.bam_files(spark, d)
    t, n = time.perf_counter(), 0
    for batch in read_range(Range(0, paths[0].removeprefix("file:"), 0, 1 << 62), COUNT_FIELDS):
        n += batch.num_rows
    one = time.perf_counter() - t
    return {"records_per_s_per_core": round(n / one), "scan_s": (took := warm(lambda: read_bam(spark, paths, 1 << 20, COUNT_FIELDS))), "scan_records_per_s": round(reads / took)}


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    queries[HEADLINE[-1]](spark, d).write.format("noop").mode("overwrite").save()  # the first query warms the session for all
    for name in HEADLINE:
        took[name] = warm(lambda n=name: queries[n](spark, d))
    reads = spark.read.parquet(f"{d}/lineitem.parquet").count()
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "counting_queries_warm_total", "value": total, "unit": "sec", "queries": took, "sf": d.rpartition("sf")[2], "alignments": reads, "alignments_per_s": round(reads / took["gene_counts_paired"]), "view": warm(lambda: fixtures.alignments(spark, d)), "prepared": prepared(spark, d), "bam": decoding(spark, d, reads)}))


if __name__ == "__main__":
    main()
