"""Worked cases of the counting rules, as data."""

import pytest
from pyspark.sql import functions as F

from locusflow.config import CountConfig as C
from locusflow.functions.cigar import cigar_blocks
from locusflow.operators.classify import classify
from locusflow.operators.feature_index import collect_features
from locusflow.operators.gene_metadata import collapsed_length, exon_numbers, gene_metadata
from locusflow.operators.interval_join import interval_join
from locusflow.operators.ordinals import with_ordinal
from locusflow.operators.pairing import candidates, mate_rows, mates_in_splits
from locusflow.plans.count import count_once, count_reads
from locusflow.sources.annotation import build_annotation, choose_type, detect_types, parse_lines
from locusflow.sources.samples import parse_sample

READ = "sample_idx int, file_ord bigint, qname string, flags int, chrom string, pos bigint, mapq int, cigar string, nh int, mate_chrom string"
GTF = [
    ("chr1", 100, 10000, "+", "gene1"), ("chr1", 20000, 30000, "+", "gene1"),
    ("chr3", 600000, 669000, "-", "gene3"), ("chr3", 602000, 631000, "+", "gene4"), ("chr2", 5, 50, ".", "gene5"),
]


def lines(spark, rows):
    return spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "value string, line_ord bigint")


@pytest.fixture(scope="module")
def ann(spark):
    rows = [f'{c}\tx\texon\t{s}\t{e}\t.\t{d}\t.\tgene_id "{g}";' for c, s, e, d, g in GTF]
    a = build_annotation(parse_lines(lines(spark, rows), "gene_id"))
    a.features.cache()
    return a


def run(spark, ann, reads, **kw):
    full = [(0, i, *r) if len(r) == 8 else (0, i, *r, None) for i, r in enumerate(reads)]
    out = count_reads(spark.createDataFrame(full, READ), ann.features, ann.chroms, C(**kw))
    key = F.col("feature_idx") if kw.get("feature_level") else F.col("gene_ord")
    name = ann.features.select(key.alias("target"), "gene_id").distinct()
    counts = {(r.gene_id if not kw.get("feature_level") else r.target): r.n for r in out.counts.join(name, "target").collect()}
    return counts, {r.status.removeprefix("Unassigned_"): r.n for r in out.status.collect()}


R1 = [("r1", 0, "chr3", 601989, 60, "20M", 1)]
R2 = [("r2", 0, "chr1", 9990, 60, "10M9999N10M", 1)]
PAIR = [("p", 1, "chr3", 601989, 60, "20M", 1, "chr3"), ("p", 17, "chr3", 630989, 60, "20M", 1, "chr3")]
IN1 = ("q", 1, "chr1", 200, 60, "20M", 1, "chr1")


@pytest.mark.parametrize(
    "reads,kw,counts,status",
    [
        (R1, {}, {}, {"Ambiguity": 1}),
        (R1, {"largest_overlap": True}, {}, {"Ambiguity": 1}),
        (R1, {"multi_overlap": True}, {"gene3": 1, "gene4": 1}, {"Assigned": 1}),
        (R1, {"multi_overlap": True, "largest_overlap": True}, {"gene3": 1}, {"Assigned": 1}),
        (R1, {"multi_overlap": True, "fraction": True}, {"gene3": 500000, "gene4": 500000}, {"Assigned": 1}),
        (R1, {"min_overlap": 15}, {"gene3": 1}, {"Assigned": 1}),
        (R1, {"min_overlap": 25}, {}, {"Overlapping_Length": 1}),
        (R1, {"frac_overlap": 0.6}, {"gene3": 1}, {"Assigned": 1}),
        (R1, {"strand": 1}, {"gene4": 1}, {"Assigned": 1}),
        (R1, {"strand": 2}, {"gene3": 1}, {"Assigned": 1}),
        (R1, {"strand": 99}, {}, {"Ambiguity": 1}),
        (R2, {}, {"gene1": 1}, {"Assigned": 1}),
        (R2, {"feature_level": True}, {}, {"Ambiguity": 1}),
        (R2, {"feature_level": True, "multi_overlap": True}, {0: 1, 1: 1}, {"Assigned": 1}),
        (R2, {"feature_level": True, "multi_overlap": True, "largest_overlap": True}, {0: 1, 1: 1}, {"Assigned": 1}),
        (PAIR, {"paired": True}, {}, {"Ambiguity": 1}),
        (PAIR, {"paired": True, "strand": 1}, {}, {"Ambiguity": 1}),
        (PAIR, {"paired": True, "strand": 2}, {}, {"Ambiguity": 1}),
        (PAIR, {"paired": True, "multi_overlap": True, "largest_overlap": True}, {"gene3": 1}, {"Assigned": 1}),
        (PAIR, {"paired": True, "frac_overlap": 0.9}, {}, {"Ambiguity": 1}),
        ([IN1] * 3, {"paired": True}, {"gene1": 2}, {"Assigned": 2}),
        ([IN1] * 3, {"paired": True, "both_aligned": True}, {"gene1": 1}, {"Assigned": 1, "Singleton": 1}),
        ([IN1, IN1[:4] + (3,) + IN1[5:]], {"paired": True, "min_mapq": 10}, {"gene1": 1}, {"Assigned": 1, "MappingQuality": 1}),
        ([("c", 1, "chr1", 200, 60, "20M", 1, "chr2"), ("c", 1, "chr2", 10, 60, "20M", 1, "chr1")], {"paired": True, "no_chimeric": True}, {}, {"Chimera": 2}),
        ([("c", 1, "chr1", 200, 60, "20M", 1, "chr2"), ("c", 1, "chr2", 10, 60, "20M", 1, "chr1")], {"paired": True}, {"gene5": 1}, {"Assigned": 1}),
        ([("u", 1 | 8, "chr1", 200, 60, "20M", 1, None)] * 2, {"paired": True}, {"gene1": 2}, {"Assigned": 2}),
        ([("m", 0, "chr1", 200, 60, "20M", 3)] * 3, {"multi_mapping": True, "fraction": True}, {"gene1": 999999}, {"Assigned": 3}),
        ([("m", 0, "chr1", 200, 60, "20M", 3)], {}, {}, {"MultiMapping": 1}),
        ([("x", 4, None, -1, 0, "*", 1)], {}, {}, {"Unmapped": 1}),
        ([("x", 0, "chrX", 5, 60, "20M", 1)], {}, {}, {"NoFeatures": 1}),
        ([("s", 0x100, "chr1", 200, 60, "20M", 1), ("d", 0x400, "chr1", 200, 60, "20M", 1)], {"primary": True, "ignore_dup": True}, {}, {"Secondary": 1, "Duplicate": 1}),
    ],
)
def test_worked_cases(spark, ann, reads, kw, counts, status):
    assert run(spark, ann, reads, **kw) == (counts, status)


def test_cigar_blocks(spark):
    cases = [("100M", 999, [(1000, 1099)]), ("50M100N50M", 999, [(1000, 1049), (1150, 1199)]), ("5S10M2D3I5M4H", 0, [(1, 17)]), ("*", 5, []), (None, 5, []), ("10M", -1, []), ("5N10M5N", 0, [(6, 15)])]
    df = spark.createDataFrame([(i, c, p) for i, (c, p, _) in enumerate(cases)], "i int, cigar string, pos bigint")
    got = {r.i: [(b.start, b.end) for b in r.b] for r in df.select("i", cigar_blocks(F.col("cigar"), F.col("pos")).alias("b")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_interval_join_equals_brute_force(spark):
    import random

    rng = random.Random(7)
    make = lambda n: [(i, f"c{rng.randrange(2)}", s := rng.randrange(300), s + rng.randrange(60)) for i in range(n)]
    a, b = make(120), make(80)
    left = spark.createDataFrame(a, "i int, chrom string, l_start bigint, l_end bigint")
    right = spark.createDataFrame(b, "j int, chrom string, r_start bigint, r_end bigint")
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    for width in (7, 64, 1000):
        assert sorted((r.i, r.j) for r in interval_join(left, right, width).collect()) == want


def test_annotation_rules(spark):
    rows = ["#c", "", "chr9\tx\texon\t1\t5\t.\t+\t.\tnote \"no id\";", 'chr1\tx\texon\t7x\t9\t.\t?\t.\tref_gene_id "r"; gene_id "g";', "chr1\tx\tCDS\t1\t2\t.\t-\t.\tID=1;gene_id=h;z", "short\tline", 'chr1\tx\texon\t\t9\t.\t-\t.\tgene_id "open']
    got = parse_lines(lines(spark, rows), "gene_id").orderBy("line_ord").collect()
    assert [(r.chrom, r.type, r.start, r.strand, r.gene_id) for r in got] == [("chr9", "exon", 1, "+", None), ("chr1", "exon", 7, ".", "r"), ("chr1", "CDS", 1, "-", "h"), ("chr1", "exon", 0, "-", None)]
    a = build_annotation(parse_lines(lines(spark, rows), "gene_id"))
    assert {r.chrom for r in a.chroms.collect()} == {"chr9", "chr1"}
    assert detect_types(lines(spark, rows)) == ["CDS", "exon"]
    assert choose_type("exon", ["CDS", "gene"]) == "CDS" and choose_type("exon", ["b", "a"][::-1]) == "a"
    with pytest.raises(ValueError):
        choose_type("tRNA", ["CDS"])


def test_gene_tables(spark, ann):
    assert {r.gene_ord: r.length for r in collapsed_length(ann.features).collect()} == {0: 19902, 1: 69001, 2: 29001, 3: 46}
    meta = {r.gene_id: (r.chr, r.starts) for r in gene_metadata(ann.features).collect()}
    assert meta["gene1"] == ("chr1;chr1", "100;20000")
    counts = spark.createDataFrame([(0, 1, 4), (0, 0, 0)], "sample_idx int, target bigint, n bigint")
    assert [tuple(r) for r in exon_numbers(ann.features, counts).collect()] == [(1, "gene1", "E001")]


def test_options_and_samples():
    assert C(output_format="dexseq").feature_level and C(strand=9).strand_mode == 0
    assert not C(min_overlap=0).needs_overlap_length and C(largest_overlap=True).needs_overlap_length
    for bad in ({"bin_width": 0}, {"frac_overlap": 1.5}, {"output_format": "x"}, {"min_mapq": -1}):
        with pytest.raises(ValueError):
            C(**bad)
    assert parse_sample("a=b=c.bam") == ("a", "b=c.bam") and parse_sample("/x/y.bam") == ("y", "/x/y.bam")


def _random_reads(seed, n=1500):
    """Names of one to five reads over two samples, spliced and not, on contigs that the annotation knows or not."""
    import random

    rng, rows = random.Random(seed), []
    cigars = ["20M", "10M900N10M", "5S15M", "8M40000N8M2D4M", "30M", "*"]
    for i in range(n):
        name, sample = f"n{rng.randrange(n // 2)}", rng.randrange(2)
        flags = rng.choice([0, 16, 1, 17, 1 | 8, 4, 0x400])
        rows.append((sample, i, f"{sample}{name}", flags, rng.choice(["c1", "c1", "c2", "cx"]), rng.randrange(60_000), rng.randrange(60), rng.choice(cigars), rng.choice([1, 1, 1, 2]), rng.choice(["c1", "c2", None])))
    return rows


def _dense_features(spark, long=True, n=240):
    """Exons of all lengths; with ``long`` one as long as the contig and one far longer than any bin."""
    import random

    rng = random.Random(3)
    made = [(f"c{1 + i % 2}", s := rng.randrange(1, 60_000), s + rng.choice([5, 50, 700, 9000, 17_000]), rng.choice("+-."), f"g{i // 3}") for i in range(n)]
    made += [("c1", 1, 250_000_000, "+", "whole"), ("c2", 30_000, 2_000_000, ".", "long"), ("c2", 9, 5, "+", "none")] if long else []
    rows = [f'{c}\tx\texon\t{s}\t{e}\t.\t{d}\t.\tgene_id "{g}";' for c, s, e, d, g in made]
    a = build_annotation(parse_lines(lines(spark, rows), "gene_id"))
    a.features.cache()
    return a


ALL_RULES = [
    {"strand": 1, "min_overlap": 12}, {"paired": True, "strand": 2, "both_aligned": True, "frac_overlap": 0.7}, {"paired": True, "multi_overlap": True, "largest_overlap": True, "feature_level": True},
    {"multi_mapping": True, "fraction": True, "multi_overlap": True, "frac_overlap_feature": 0.02}, {"paired": True, "no_chimeric": True, "primary": True, "ignore_dup": True, "largest_overlap": True},
]


@pytest.mark.parametrize("kw", ALL_RULES, ids=str)
def test_three_ways_to_resolve_agree(spark, tmp_path, kw):
    """In rows, by join (as for annotations too large to send), and in splits, where names are spread over all of them."""
    ann, cfg = _dense_features(spark, "multi_overlap" in kw, 30), C(**kw)
    spark.createDataFrame(_random_reads(11), READ).repartitionByRange(7, "file_ord").write.parquet(str(tmp_path / "r"))
    reads = spark.read.parquet(str(tmp_path / "r"))
    here = count_reads(reads, ann.features, ann.chroms, cfg)
    joined = count_reads(reads, ann.features, ann.chroms, cfg)
    joined.index = None
    kept = count_once(reads, ann.features, ann.chroms, cfg, True)
    rows = lambda df, *c: sorted(tuple(map(str, r)) for r in df.select(*c).collect())
    for x in (here, kept):
        assert rows(x.counts, "sample_idx", "target", "n") == rows(joined.counts, "sample_idx", "target", "n")
        assert rows(x.status, "sample_idx", "status", "n") == rows(joined.status, "sample_idx", "status", "n")
        assert rows(x.resolved, "first_ord", "qname", "nh", "status", F.array_sort("targets"), "filtered") == rows(joined.resolved, "first_ord", "qname", "nh", "status", F.array_sort("targets"), "filtered")
    assert here.counts.count() > 5


@pytest.mark.parametrize("parts,ranges", [(1, True), (2, True), (9, True), (5, False)])
def test_pairs_of_splits_are_those_of_the_file(spark, tmp_path, parts, ranges):
    """Also names that stand twice in one split and once in another, whose reads are gone through again; and splits that are no ranges."""
    rows = spark.createDataFrame(_random_reads(parts), READ)
    (rows.repartitionByRange(parts, "file_ord") if ranges else rows.repartition(parts, "pos")).write.parquet(str(tmp_path / "r"))
    reads = spark.read.parquet(str(tmp_path / "r"))
    own = candidates(classify(reads, spark.createDataFrame([("c1",), ("c2",)], "chrom string"), C(paired=True, multi_mapping=True)), False)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select("qname", "kind", "rec.file_ord", "mate.file_ord", "first_ord", "mate.blocks").collect())
    assert rows(mates_in_splits(own)) == rows(mate_rows(own))
    assert own.where("NOT solo").groupBy("qname").count().where("count > 2").count() > 20


def test_a_long_group_of_one_name(spark):
    """A name over many Arrow batches pairs on across their bounds."""
    rows = [(0, i, "same" if i < 25_001 else f"u{i}", 1, "c1", 5, 9, "5M", 1, "c1") for i in range(30_000)]
    own = candidates(classify(spark.createDataFrame(rows, READ).coalesce(1), spark.createDataFrame([("c1",)], "chrom string"), C(paired=True)), False)
    got = {r.kind: r.n for r in mates_in_splits(own).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert got == {"pair": 12_500, "orphan": 5_000}


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Exchange SinglePartition")


def test_what_is_shuffled(spark, tmp_path):
    """Single reads: the sums only. Pairs: the reads that passed, and the sums; of filtered reads only counts."""
    ann, chroms = _dense_features(spark), spark.createDataFrame([("c1",), ("c2",)], "chrom string")
    spark.createDataFrame(_random_reads(1), READ).write.parquet(str(tmp_path / "r"))
    reads = spark.read.parquet(str(tmp_path / "r"))
    assert _exchanges(count_reads(reads, ann.features, chroms, C()).counts)[0] == 1
    assert _exchanges(count_reads(reads, ann.features, chroms, C()).status)[0] == 1
    assert _exchanges(count_reads(reads, ann.features, chroms, C(paired=True)).counts)[0] == 2
    status = count_reads(reads, ann.features, chroms, C(paired=True)).status
    assert "dropped" not in status._jdf.queryExecution().optimizedPlan().toString()  # no filtered read is dealt out for pairing


def test_features_of_any_length_stand_once(spark):
    ann = _dense_features(spark)
    arrays = collect_features(ann.features, C(feature_level=True))
    assert len(arrays.start) == ann.features.where("start <= end").count() and len(arrays.ends) > 3
    import random

    import numpy as np

    rng = random.Random(8)
    s = np.array([rng.randrange(0, 80_000) for _ in range(400)])
    e, contig = s + np.array([rng.choice([-1, 0, 30, 20_000]) for _ in s]), np.array([rng.randrange(-1, 2) for _ in s])
    got = sorted((int(b), int(arrays.target[f])) for b, f in zip(*arrays.hits(contig, s, e), strict=True))
    known = [(arrays.contigs.index(r.chrom), r.start, r.end, r.feature_idx) for r in ann.features.collect()]
    assert got == sorted((i, t) for i in range(400) for c, a, b, t in known if c == contig[i] and a <= b and s[i] <= e[i] and a <= e[i] and s[i] <= b)


def test_interval_join_of_long_intervals(spark):
    rows = [(0, "c", 1, 250_000_000), (1, "c", 16_384, 16_384), (2, "c", 1, 1), (3, "d", 5, 4)]
    right = spark.createDataFrame(rows, "j int, chrom string, r_start bigint, r_end bigint")
    left = spark.createDataFrame([(0, "c", 1, 1), (1, "c", 249_999_999, 260_000_000), (2, "c", 16_000, 17_000), (3, "c", 9, 8), (4, "d", 1, 9)], "i int, chrom string, l_start bigint, l_end bigint")
    pairs = [(r.i, r.j) for r in interval_join(left, right, 16_384).collect()]
    assert sorted(pairs) == [(0, 0), (0, 2), (1, 0), (2, 0), (2, 1)]


def test_ordinals_are_those_of_one_sort(spark):
    rows = spark.range(5000).selectExpr("id", "pmod(xxhash64(id), 300) AS k", "struct(pmod(id, 7) AS b, id AS i) AS s")
    got = sorted((r.n, r.k, r.id) for r in with_ordinal(rows, "n", "k", F.col("s")).collect())
    want = sorted((r.k, r.s.b, r.id) for r in rows.collect())
    assert got == [(n, k, i) for n, (k, _, i) in enumerate(want)]
    assert with_ordinal(rows.where("false"), "n", "k").collect() == []


def test_annotation_without_one_task_sorts(spark, ann):
    built = build_annotation(parse_lines(lines(spark, [f'c{i % 3}\tx\texon\t{i}\t{i + 5}\t.\t+\t.\tgene_id "g{i % 11}";' for i in range(200)]), "gene_id"))
    for t in (built.features, built.genes, built.chroms):
        assert _exchanges(t)[1] == 0
    assert [r.feature_idx for r in built.features.orderBy("chrom_ord", "start", "line_ord").collect()] == list(range(200))
