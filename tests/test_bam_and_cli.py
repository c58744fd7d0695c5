import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow import cli
from locusflow.functions.cigar import cigar_blocks
from locusflow.config import CountConfig
from locusflow.plans import fixtures
from locusflow.plans.output import table, write_counts
from locusflow.sources import alignments, sam
from locusflow.sources.annotation import build_annotation, detect_types, is_saf, parse_lines, parse_saf, read_lines
from locusflow.sources.bam import Range, detect_paired, nh_tags, read_bam, read_range, read_region
from locusflow.sources.bam_index import build_index, parse_index, smallest_bin
from locusflow.sources.line_sink import TableSink
from tests import bam_writer as bw


def nh_tag(tags):
    raw = np.frombuffer(b"xx" + tags + b"NHC\x09", np.uint8)  # what follows the record is no tag of it
    return int(nh_tags(raw, np.array([2]), np.array([2 + len(tags)]))[0])


def test_nh_tag():
    md = b"MDZ100\0" + b"SAZx,1\0" + b"XBBi" + struct.pack("<iii", 2, 1, 2)
    assert nh_tag(md + b"NHC\xff") == 255 and nh_tag(md + b"NHS" + struct.pack("<H", 300)) == 300
    assert nh_tag(b"NHi" + struct.pack("<i", 70000)) == 65535 and nh_tag(b"NHi" + struct.pack("<i", -4)) == 1
    many = [md + b"NHC\x07", b"", b"NHc\xff", b"XXA1NHI" + struct.pack("<I", 1 << 31), b"XXBc" + struct.pack("<I", 3) + b"abcNHs\x05\x00", b"XXBA\1\0\0\0aNHC\x05", b"XXZnoend", b"NHi\1"]
    ends = np.cumsum([len(x) for x in many])
    assert nh_tags(np.frombuffer(b"".join(many), np.uint8), ends - [len(x) for x in many], ends).tolist() == [7, 1, 1, 65535, 5, 1, 1, 1] == [nh_tag(x) for x in many]
    assert nh_tag(b"NHZ5\0") == nh_tag(b"XX?1NHC\x05") == nh_tag(b"") == 1


@pytest.mark.parametrize("split", [1 << 26, 9000])
def test_round_trip_whole_and_split(spark, tmp_path, split):
    recs = [(f"r{i}", 1 if i % 3 else 0, i % 2, i * 7, i % 60, "20M5N10M", (i + 1) % 2, b"NHC" + bytes([1 + i % 4]), 150) for i in range(4000)]
    path = str(tmp_path / "a.bam")
    bw.write(path, ["chr1", "chr2"], [bw.record(*r) for r in recs], size=20_000)
    df = read_bam(spark, [path], split)
    rows = df.orderBy("file_ord").collect()
    assert [(r.qname, r.flags, r.chrom, r.pos, r.mapq, r.cigar, r.mate_chrom, r.nh) for r in rows] == [
        (q, f, f"chr{c + 1}", p, m, g, f"chr{x + 1}", t[3]) for q, f, c, p, m, g, x, t, _ in recs
    ]
    assert detect_paired(path) and (split > 1 << 20 or df.rdd.getNumPartitions() > 5)


def test_records_of_any_size_at_any_split(spark, tmp_path):
    """Long reads among short ones: each split finds just the records that begin in its blocks."""
    rng, recs = np.random.default_rng(2), []
    for i in range(60):
        long = 700_000 if i % 20 == 7 else int(rng.integers(0, 300))
        body = bw.record(f"r{i}", 1, i % 2, i, 9, "10M5N3M", 0, rng.integers(0, 256, 10, np.uint8).tobytes() * 0, long)
        noise = bytearray(body)
        noise[-long:] = rng.integers(0, 256, long, np.uint8).tobytes() if long else noise[-long:]
        recs.append(bytes(noise))
    path = str(tmp_path / "long.bam")
    bw.write(path, ["c1", "c2"], recs, size=60_000)
    n, fields = (tmp_path / "long.bam").stat().st_size, ["file_ord", "qname", "pos"]
    whole = [r for b in read_range(Range(0, path, 0, n), fields) for r in b.to_pylist()]
    assert [r["qname"] for r in whole] == [f"r{i}" for i in range(60)]
    for split in (1 << 14, 1 << 16, 300_000, 1 << 20):
        got = [r for a in range(0, n, split) for b in read_range(Range(0, path, a, min(n, a + split)), fields) for r in b.to_pylist()]
        assert got == whole


def test_blocks_equal_those_of_the_cigar_text(spark, tmp_path):
    cigars = ["10M", "", "5S10M2D3I5M4H", "50M100N50M", "5N10M5N", "3N", "10I", "2M3N4M5N6M", "7=2X1D", "3D4N5M"]
    path = str(tmp_path / "c.bam")
    bw.write(path, ["c"], [bw.record(f"r{i}", 0, 0, i * 10 - (i == 3), 9, c) for i, c in enumerate(cigars * 3)])
    for r in read_bam(spark, [path]).select("blocks", cigar_blocks(F.col("cigar"), F.col("pos")).alias("again")).collect():
        assert r.blocks == r.again
    assert read_bam(spark, [path], fields=["flags", "qname"]).columns == ["flags", "qname"]


def test_detection_reads_the_head_only(tmp_path):
    path = str(tmp_path / "h.bam")
    bw.write(path, ["c"], [bw.record(f"r{i}", int(i == 1500), 0, 1, 9, "5M") for i in range(3000)])
    assert not detect_paired(path) and detect_paired(path, 1501)


def test_annotation_names_that_mislead(spark, tmp_path):
    text = "".join(f'chr1\tx\t{"gene" if i < 10_050 else "exon"}\t{i}\t{i + 5}\t.\t+\t.\tgene_id "g{i}";\n' for i in range(10_100))
    for name, data in (("a.data", gzip.compress(text.encode())), ("b.gtf.gz", text.encode()), ("c.gz", gzip.compress(text[:90_000].encode()) + gzip.compress(text[90_000:].encode())), ("d.txt", text.encode())):
        (tmp_path / name).write_bytes(data)
        lines = read_lines(spark, str(tmp_path / name))
        assert [r.value for r in lines.orderBy("line_ord").collect()] == text.splitlines()
        assert detect_types(lines) == ["gene"]  # the exons stand after the first ten thousand lines


def test_truncated_and_wrong_files(spark, tmp_path):
    good = str(tmp_path / "g.bam")
    bw.write(good, ["c"], [bw.record("a", 0, 0, 1, 9, "5M"), bw.record("b", 0, 0, 1, 9, "5M")[:-6]], tail=False)
    assert [r.qname for r in read_bam(spark, [good]).collect()] == ["a"]
    (tmp_path / "n.bam").write_bytes(b"no bam here")
    with pytest.raises(Exception, match="not a BAM"):
        read_bam(spark, [str(tmp_path / "n.bam")]).collect()


def test_cli_end_to_end(spark, tmp_path):
    gtf = tmp_path / "a.data"  # gzipped, though its name does not say so
    gtf.write_bytes(gzip.compress(b'chr1\tx\texon\t1\t100\t.\t+\t.\tgene_id "g1";\r\nchr1\tx\texon\t200\t300\t.\t-\t.\tgene_id "g2";\n'))
    bam, out = str(tmp_path / "s.bam"), tmp_path / "counts.txt"
    bw.write(bam, ["chr1"], [bw.record("a", 0, 0, 10, 60, "20M"), bw.record("b", 0, 0, 500, 60, "20M"), bw.record("c", 4, -1, -1, 0, "")])
    args = ["-q", "-a", str(gtf), "-o", str(out), f"one={bam}", bam]
    assert cli.main(args) == 0
    got = out.read_text().splitlines()
    assert got[1:] == ["Geneid\tChr\tStart\tEnd\tStrand\tLength\tone\ts", "g1\tchr1\t1\t100\t+\t100\t1\t1", "g2\tchr1\t200\t300\t-\t101\t0\t0"]
    summary = (tmp_path / "counts.summary").read_text().splitlines()
    assert summary[1] == "Assigned\t2\t33.33%" and len(summary) == 14
    cli.main(["-q", "--format", "dexseq", "-a", str(gtf), "-o", str(tmp_path / "d.txt.gz"), bam, "-d", str(tmp_path / "det")])
    assert gzip.open(tmp_path / "d.txt.gz", "rt").read().splitlines() == ["gene_id\texon_id\ts", "g1\tg1:E001\t1"]
    cli.main(["-q", "-f", "-M", "--fraction", "-a", str(gtf), "-o", str(tmp_path / "f.txt"), bam])
    assert (tmp_path / "f.txt").read_text().splitlines()[2] == "g1\tchr1\t1\t100\t+\t100\t1.000000"
    assert spark.read.parquet(str(tmp_path / "det")).count() == 2


def _placed(n=4000, contigs=3):
    """Records sorted by place over several contigs, some spliced far, some unmapped beside their mate; and bytes of each."""
    rng = np.random.default_rng(4)
    rows = sorted((int(rng.integers(0, contigs)), int(rng.integers(0, 40_000_000 if i % 3 else 90_000)), i) for i in range(n))
    return [(c, p, f"r{i}", ["50M", "20M300000N30M", "*", "5S40M2D5M"][i % 4]) for c, p, i in rows]


def _write_sorted(path, recs, contigs=3):
    out = fixtures.BamFile(str(path), b"BAM\x01" + bytes(4) + contigs.to_bytes(4, "little") + b"".join(struct.pack("<i", 3) + f"c{i}".encode() + b"\0" + struct.pack("<i", 1 << 28) for i in range(contigs)))
    for c, p, name, cigar in recs:
        reach = {"50M": 50, "20M300000N30M": 300_050, "*": 0, "5S40M2D5M": 47}[cigar]
        out.add(bw.record(name, 4 if cigar == "*" else 0, c, p, 9, cigar.replace("*", "")), c, p, reach)
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(fixtures, "CONTIGS", ["c0", "c1", "c2"])
    monkeypatch.setattr(fixtures.BamFile, "SIZE", 2_000)


def _over(recs, contig, first, last):
    reach = {"50M": 50, "20M300000N30M": 300_050, "*": 1, "5S40M2D5M": 47}
    return sorted(n for c, p, n, g in recs if f"c{c}" == contig and p < last and p + reach[g] > first - 1)


@pytest.mark.parametrize("region", ["c1:1-20000", "c1:89000-400000", "c2:16384-16385", "c0", "c2:39999000-50000000", "c1:500000000-600000000", "c9:1-5", "c1:7-6"])
def test_regions_by_index(spark, tmp_path, small_blocks, region):
    """By the index and without one the same records, and only what the index lists is read."""
    recs, path = _placed(), str(tmp_path / "s.bam")
    _write_sorted(path, recs).close(True)
    contig, _, span = region.partition(":")
    first, last = map(int, span.split("-")) if span else (1, 1 << 29)
    found = read_region(spark, [path], region, 4_000)
    assert sorted(r.qname for r in found.collect()) == _over(recs, contig, first, last)
    whole = read_bam(spark, [path], 4_000).rdd.getNumPartitions()
    assert whole > 10 and (not span or found.rdd.getNumPartitions() * 2 < whole)
    (tmp_path / "s.bam.bai").unlink()
    assert sorted(r.qname for r in read_region(spark, [path], region, 4_000).collect()) == _over(recs, contig, first, last)


def test_index_of_known_bytes():
    """One contig, two alignments of one bin and one that crosses into the next: bins and windows as the format has them."""
    raw = build_index(2, [(0, 100, 200, 5 << 16, 9 << 16), (0, 150, 160, 9 << 16, 11 << 16), (0, 16_380, 16_390, 11 << 16, 20 << 16), (-1, -1, 0, 20 << 16, 21 << 16)])
    one, two = parse_index(raw)
    assert one.bins == {4681: [(5 << 16, 11 << 16)], 585: [(11 << 16, 20 << 16)]} and one.linear == [5 << 16, 11 << 16] and not two.bins
    assert smallest_bin(0, 1) == 4681 and smallest_bin(0, 1 << 29) == 0 and smallest_bin(1 << 17, (1 << 17) + 5) == 4681 + 8
    with pytest.raises(ValueError):
        parse_index(b"no index")


SAM = [
    "@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:c1\tLN:900", "@SQ\tSN:c2\tLN:900",
    "a\t99\tc1\t11\t60\t5M2N5M\t=\t90\t100\tACGT\tIIII\tMD:Z:NH:i:7\tNH:i:3\tXX:A:q", "b\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*", "short\t4\t*", "", "c\t16\tc2\t5\t9\t4M\tc1\t8\t0\t*\t*\tNH:i:70000\r",
]


def test_sam_records(spark, tmp_path):
    path = tmp_path / "x y.sam"
    path.write_text("\n".join(SAM) + "\n")
    rows = sam.read_sam(spark, [str(path)], ["MD", "XX"]).orderBy("file_ord").collect()
    assert [tuple(r)[2:] for r in rows] == [
        ("a", 99, "c1", 10, 60, "5M2N5M", 3, "c1", "NH:i:7", "q"), ("b", 4, None, -1, 0, "*", 1, None, None, None), ("c", 16, "c2", 4, 9, "4M", 65535, "c1", None, None),
    ]
    assert sam.header(str(path)) == ({"VN": "1.6", "SO": "coordinate"}, ["c1", "c2"]) and sam.is_sam(str(path)) and alignments.detect_paired(str(path))


def test_sam_order_over_splits(spark, tmp_path):
    paths = [tmp_path / f"{i}.sam" for i in range(2)]
    for i, p in enumerate(paths):
        p.write_text("".join(f"s{i}r{n}\t1\tc1\t{n + 1}\t9\t{5 + n % 7}M\t=\t1\t0\t*\t*\n" for n in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = sam.read_sam(spark, list(map(str, paths)))
        assert df.rdd.getNumPartitions() > 8
        for i in range(2):
            assert [r.qname for r in df.where(f"sample_idx = {i}").orderBy("file_ord").collect()] == [f"s{i}r{n}" for n in range(4000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cli_with_sam_saf_and_bam(spark, tmp_path):
    """Formats may be mixed; samples keep the order of the arguments."""
    (tmp_path / "f.saf").write_text("@SQ\tSN:c1\tLN:900\ng1\tc1\t1\t100\t+\ng2\tc1\t200\t300\t*\textra\n\tc1\t1\t9\t-\n")
    (tmp_path / "t.sam").write_text("r\t0\tc1\t250\t60\t9M\t*\t0\t0\t*\t*\nq\t0\tc1\t10\t60\t9M\t*\t0\t0\t*\t*\n")
    bam, out = str(tmp_path / "b.bam"), tmp_path / "o.txt"
    bw.write(bam, ["c1"], [bw.record("a", 0, 0, 10, 60, "20M")])
    assert cli.main(["-q", "-a", str(tmp_path / "f.saf"), "-o", str(out), f"t={tmp_path / 't.sam'}", bam, f"u={tmp_path / 't.sam'}"]) == 0
    assert out.read_text().splitlines()[1:] == ["Geneid\tChr\tStart\tEnd\tStrand\tLength\tt\tb\tu", "g1\tc1\t1\t100\t+\t100\t1\t1\t1", "g2\tc1\t200\t300\t.\t101\t1\t0\t1"]


def test_saf_is_told_by_its_first_line(spark, tmp_path):
    for text, yes in (("#c\nGeneID\tChr\tStart\tEnd\tStrand\ng\tc\t1\t2\t+\n", True), ("g\tc\t1\t2\t+\n", True), ("g\tc\tx\t2\t+\n", False), ('c\ts\texon\t1\t2\t.\t+\t.\tgene_id "g";\n', False), ("", False)):
        (tmp_path / "a").write_text(text)
        lines = read_lines(spark, str(tmp_path / "a"))
        assert is_saf(lines) == yes
        if yes:
            assert [(r.gene_id, r.chrom, r.start, r.end) for r in parse_saf(lines).collect()] == [("g", "c", 1, 2)]


def _table_of(spark, tmp_path, samples, genes, name, parts=None):
    """A count table of ``samples`` with few counts, written in one piece or in several; and the lines that it should have."""
    ann = build_annotation(parse_lines(spark.createDataFrame([(f'c\tx\texon\t{i * 10 + 1}\t{i * 10 + 5}\t.\t+\t.\tgene_id "g{i}";', i) for i in range(genes)], "value string, line_ord bigint"), "gene_id"))
    counts = [(s, g, 1 + s + g) for s in range(0, samples, 97) for g in range(0, genes, 3)]
    result = type("Made", (), {"counts": spark.createDataFrame(counts, "sample_idx int, target bigint, n bigint")})()
    path = tmp_path / name
    if parts:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        write_counts(result, ann, [(f"s{i}", "") for i in range(samples)], CountConfig(), str(path), "me")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    held = {(s, g): n for s, g, n in counts}
    want = ["# me", "\t".join(["Geneid", "Chr", "Start", "End", "Strand", "Length", *(f"s{i}" for i in range(samples))])]
    want += ["\t".join([f"g{g}", "c", str(g * 10 + 1), str(g * 10 + 5), "+", "5", *(str(held.get((s, g), 0)) for s in range(samples))]) for g in range(genes)]
    data = path.read_bytes()
    assert (gzip.decompress(data) if name.endswith(".gz") else data).decode().splitlines() == want
    assert [p.name for p in tmp_path.iterdir()] == [name]  # no part is left
    return result, ann


@pytest.mark.parametrize("name,parts", [("t.txt", None), ("t.gz", None), ("t.txt", 5), ("t.gz", 5)])
def test_tables_in_one_and_many_parts(spark, tmp_path, name, parts):
    _table_of(spark, tmp_path, 3, 40, name, parts)


def test_table_of_five_thousand_samples(spark, tmp_path):
    """The plan does not grow with the samples."""
    result, ann = _table_of(spark, tmp_path, 5000, 7, "many.txt")
    assert len(table(result, ann, CountConfig()).columns) == 3


def test_failed_tables_leave_nothing(spark, tmp_path):
    spark.dataSource.register(TableSink)
    bad = spark.range(3).select(F.array(F.lit("g")).alias("fields"), F.array(F.struct(F.lit(9).alias("sample"), F.lit("1").alias("n"))).alias("counts"))
    with pytest.raises(Exception, match="list assignment index"):
        bad.write.format("count_table").options(head="[]", samples=2, zero="0").mode("append").save(str(tmp_path / "t"))
    assert list(tmp_path.iterdir()) == []
    none = bad.where("false")
    none.write.format("count_table").options(head='["h"]', samples=2, zero="0").mode("append").save(str(tmp_path / "t"))
    assert (tmp_path / "t").read_text() == "h\n"
