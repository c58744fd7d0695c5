"""What must not land in one task, however large the tables are."""

import os
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.plans import catalog, fixtures
from locusflow.sources.annotation import build_annotation
from locusflow.sources.bam import read_bam, read_region
from locusflow.sources.bam_index import build_index, index_bytes, index_entries, parse_index, smallest_bin

D = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@tables
def test_files_come_in_ranges_of_their_order(uncoalesced):
    rows = fixtures.ordered_alignments(uncoalesced, D).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert len(sizes) > 2 and max(sizes) < sum(sizes) / 4
    ranges = rows.groupBy("sample_idx", "part").agg(F.min("file_ord"), F.max("file_ord")).orderBy("sample_idx", "part").collect()
    assert all(a[3] < b[2] for a, b in zip(ranges, ranges[1:], strict=False) if a[0] == b[0])


@tables
def test_parts_make_whole_files(uncoalesced):
    """Files of many parts have all records in their order, and a sorted one's index finds those of a region."""
    paths = fixtures.bam_files(uncoalesced, D)
    want = [r[0] for r in fixtures.alignments(uncoalesced, D).where("sample_idx = 1").orderBy("file_ord").select("qname").collect()]
    assert [r[0] for r in read_bam(uncoalesced, paths[1:], 1 << 16, ["qname", "file_ord"]).orderBy("file_ord").select("qname").collect()] == want
    paths = fixtures.bam_files(uncoalesced, D, by_place=True)
    region = lambda: sorted(read_region(uncoalesced, paths, "chr3:20000-60000", 1 << 16, ["qname", "flags"]).collect())
    found = region()
    for p in paths:
        os.rename(p.removeprefix("file://") + ".bai", p.removeprefix("file://") + ".gone")
    assert found and found == region()
    raw = open(paths[0].removeprefix("file://"), "rb").read()
    assert raw.count(fixtures.bgzf_block(b"")) == 1 and raw.endswith(fixtures.bgzf_block(b""))


def test_index_of_parts():
    """Parts far into a file have the index that their alignments have as a whole."""
    rng = np.random.default_rng(5)
    begin = np.sort(rng.integers(0, 3_000_000, 4000))
    rows = [(i % 4000 // 2000, int(b), int(b + rng.choice([50, 700, 300_000])), (i // 40) << 17 | i % 40 * 100) for i, b in enumerate(begin)]
    rows = sorted(rows, key=lambda r: r[3])
    whole = [(*r, after) for r, after in zip(rows, [*(r[3] for r in rows[1:]), 100 << 17], strict=True)]
    parts = []
    for lo, hi in ((0, 1200), (1200, 1240), (1240, 4000)):
        at = whole[lo][3] >> 16
        parts.append((at, index_entries(*(np.array(x) for x in zip(*((*r[:3], r[3] - (at << 16), r[4] - (at << 16)) for r in whole[lo:hi]), strict=True)))))
    raw = index_bytes(3, parts)
    assert raw == build_index(3, whole)
    found = parse_index(raw)
    for contig, b, e, at, after in whole:
        assert any(x <= at and after <= y for x, y in found[contig].bins[smallest_bin(b, e)])
        assert all(found[contig].linear[w] <= at for w in range(b >> 14, (e - 1 >> 14) + 1))
    assert not found[2].bins and struct.unpack_from("<i", raw, 4)[0] == 3


@tables
def test_fixture_features_are_numbered_in_buckets(spark, monkeypatch):
    """Numbers are those of the annotation reader, however many buckets there are, and no window but those over buckets lies in one partition."""
    rows = fixtures._sql(spark, fixtures.FEATURES_SQL, "part", D)
    reader = build_annotation(rows.select("chrom", F.col("f_start").alias("start"), F.col("f_end").alias("end"), "strand", "gene_id", F.col("feat_ord").alias("line_ord")))
    places = ["line_ord", "feature_idx", "gene_id", "chrom_ord", "chrom", "start", "end", "strand"]
    want = sorted(reader.features.select(*places).collect())
    genes = [r.gene_id for r in reader.genes.orderBy("gene_ord").collect()]
    for bases in (12, 20):
        monkeypatch.setattr(fixtures, "BASES", bases)
        found = fixtures.annotation(spark, D)
        features = found.features
        assert sorted(features.select(*places).collect()) == want
        assert [r.gene_id for r in found.genes.orderBy("gene_ord").collect()] == genes
    windows = re.findall(r"(\w+\([^()]*\)) windowspecdefinition\(\w+#\d+L? ASC", features._jdf.queryExecution().optimizedPlan().toString())
    assert windows and all(re.match(r"sum\(n#|dense_rank\(o#", x) for x in windows)  # without partitions only sums of buckets are looked at


@tables
def test_lines_of_a_file_are_numbered_in_ranges(spark, tmp_path, monkeypatch):
    """A table's lines have their numbers in the file, and no row comes through the driver."""
    path = tmp_path / "counts.txt"
    path.write_text("".join(f"g{i * 7919 % 5000}\t{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = catalog._numbered_lines(spark, str(path))
        assert [tuple(r) for r in lines.orderBy("line").collect()] == [(i, f"g{i * 7919 % 5000}\t{i}") for i in range(5000)]
        assert "LocalTableScan" not in lines._jdf.queryExecution().toString() and "Window" not in lines._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_annotation_lines_are_parsed_once(spark):
    """Numbering contigs, genes and features goes through the parsed rows, not through the lines again."""
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([("c1", i, i + 5, "+", f"g{i % 3}", i) for i in range(40)], "chrom string, start bigint, end bigint, strand string, gene_id string, line_ord bigint")

    def parse(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    found = build_annotation(rows.mapInArrow(parse, rows.schema))
    assert found.features.count() == 40 and found.genes.count() == 3
    assert seen.value == 40
