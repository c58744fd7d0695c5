"""Named queries over the driver's tables, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.config import CountConfig
from locusflow.functions.cigar import cigar_blocks
from locusflow.functions.intervals import overlap_length
from locusflow.operators import gene_metadata as gm
from locusflow.operators.classify import classify
from locusflow.operators.counts import assignment_rate, summary
from locusflow.operators.interval_join import interval_join
from locusflow.operators.ordinals import with_ordinal
from locusflow.operators.pairing import candidates, mate_rows, mates_in_splits, with_blocks
from locusflow.plans import fixtures, oracle
from locusflow.plans.count import count_once, count_reads
from locusflow.plans.output import write_counts, write_details, write_summary
from locusflow.sources.alignments import detect_paired, read_alignments
from locusflow.sources.annotation import build_annotation, choose_type, detect_types, load_annotation, parse_lines, read_lines
from locusflow.sources.bam import COUNT_FIELDS, read_bam, read_region
from locusflow.sources.sam import read_sam
from locusflow.sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
C = CountConfig
STRICT = C(min_mapq=10, primary=True, ignore_dup=True)
PAIRED = C(paired=True)

#: Count queries: gene or feature counts per sample under these options.
COUNTS = {
    "gene_counts_single": C(),
    "gene_counts_strict": STRICT,
    "gene_counts_paired": PAIRED,
    "gene_counts_both_aligned": C(paired=True, both_aligned=True),
    "gene_counts_no_chimeric": C(paired=True, no_chimeric=True),
    "stranded_single": C(strand=1),
    "reverse_stranded_single": C(strand=2),
    "stranded_paired": C(paired=True, strand=1),
    "min_overlap": C(min_overlap=20),
    "min_overlap_paired": C(paired=True, min_overlap=60),
    "frac_overlap_single": C(frac_overlap=0.6),
    "frac_overlap_paired": C(paired=True, frac_overlap=0.9),
    "frac_overlap_feature": C(frac_overlap_feature=0.1),
    "multi_overlap": C(multi_overlap=True),
    "largest_overlap": C(paired=True, multi_overlap=True, largest_overlap=True),
    "largest_overlap_no_multi": C(paired=True, largest_overlap=True),
    "multi_mapping": C(multi_mapping=True, paired=True),
    "fractional_nh": C(multi_mapping=True, fraction=True),
    "fractional_multi_overlap": C(multi_mapping=True, fraction=True, multi_overlap=True, paired=True),
    "fraction_without_multi_mapping": C(fraction=True, multi_overlap=True),
    "feature_counts": C(feature_level=True),
    "feature_counts_multi": C(feature_level=True, multi_overlap=True, paired=True),
}
#: Status queries: reads and fragments per outcome under these options.
STATUS = {
    "status_summary_single": C(),
    "status_summary_strict": STRICT.with_(paired=True),
    "status_summary_paired": PAIRED,
    "status_both_aligned": C(paired=True, both_aligned=True),
    "status_no_chimeric": C(paired=True, no_chimeric=True),
    "status_overlapping_length": C(min_overlap=40, frac_overlap=0.5),
}


def _run(spark, d, cfg):
    ann = fixtures.annotation(spark, d)
    return count_reads(fixtures.alignments(spark, d), ann.features, ann.chroms, cfg), ann


def _counts(cfg: C) -> Query:
    def query(spark, d):
        result, ann = _run(spark, d, cfg)
        idx = F.col("sample_idx").cast("bigint").alias("sample_idx")
        if cfg.feature_level:
            return result.counts.join(ann.features, F.col("target") == F.col("feature_idx")).select(idx, F.col("line_ord").alias("feat_ord"), "n")
        return result.counts.join(ann.genes, F.col("target") == F.col("gene_ord")).select(idx, "gene_id", "n")

    return query


def _status(cfg: C) -> Query:
    return lambda spark, d: _run(spark, d, cfg)[0].status.select(F.col("sample_idx").cast("bigint").alias("sample_idx"), "status", "n")


def _filter_status(cfg: C) -> Query:
    def query(spark, d):
        out = classify(fixtures.alignments(spark, d), fixtures.annotation(spark, d).chroms, cfg)
        return out.groupBy(F.coalesce("status", F.lit("Passed")).alias("status")).agg(F.count("*").alias("n"))

    return query


def _filter_sql(cfg: C) -> str:
    return f"WITH {oracle.reads_sql(cfg)} SELECT coalesce(status,'Passed') AS status, CAST(count(*) AS BIGINT) AS n FROM cls GROUP BY 1"


def cigar_block_rows(spark, d):
    a = fixtures.alignments(spark, d).select("qname", "file_ord", "chrom", F.explode(cigar_blocks(F.col("cigar"), F.col("pos"))).alias("b"))
    return a.select("qname", "file_ord", "chrom", F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end"))


def _block_hits(spark, d):
    left = cigar_block_rows(spark, d).select("file_ord", "chrom", F.col("b_start").alias("l_start"), F.col("b_end").alias("l_end"))
    f = fixtures.annotation(spark, d).features.select("chrom", F.col("line_ord").alias("feat_ord"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return interval_join(left, f, C().bin_width)


def interval_join_hits(spark, d):
    return _block_hits(spark, d).select("file_ord", "feat_ord", F.col("l_start").alias("b_start"))


def hit_overlap_len(spark, d):
    ol = overlap_length(*(F.col(c) for c in ("l_start", "l_end", "r_start", "r_end")))
    return _block_hits(spark, d).groupBy("file_ord", "feat_ord").agg(F.sum(ol).alias("overlap"))


def _mates(spark, d):
    reads = classify(fixtures.alignments(spark, d), fixtures.annotation(spark, d).chroms, PAIRED)
    return mate_rows(with_blocks(reads.where("status IS NULL")))


def mate_pairing(spark, d):
    return _mates(spark, d).where("kind = 'pair'").select("qname", F.col("rec.file_ord").alias("rec"), F.col("mate.file_ord").alias("mate"))


def orphans(spark, d):
    return _mates(spark, d).where("kind <> 'pair'").select("qname", "kind", F.col("rec.file_ord").alias("rec"))


def collapsed_gene_length(spark, d):
    ann = fixtures.annotation(spark, d)
    return gm.collapsed_length(ann.features).join(ann.genes, "gene_ord").select("gene_id", "length")


def gene_metadata(spark, d):
    return gm.gene_metadata(fixtures.annotation(spark, d).features).select("gene_id", "chr", "starts", "ends", "strands")


def exon_numbering(spark, d):
    result, ann = _run(spark, d, C(feature_level=True))
    return gm.exon_numbers(ann.features, result.counts).join(ann.features.select("feature_idx", "line_ord"), "feature_idx").select(F.col("line_ord").alias("feat_ord"), "gene_id", "exon_id")


def count_matrix_pivot(spark, d):
    result, ann = _run(spark, d, C())
    return gm.count_matrix(ann.genes.withColumn("target", F.col("gene_ord")), result.counts, [0, 1]).join(ann.genes, F.col("target") == F.col("gene_ord")).select("gene_id", "s0", "s1")


def summary_table(spark, d):
    return summary(spark, _run(spark, d, PAIRED)[0].status).select(F.col("ord").cast("bigint").alias("ord"), "status", "n")


def sample_totals(spark, d):
    return assignment_rate(_run(spark, d, C())[0].status).select(F.col("sample_idx").cast("bigint").alias("sample_idx"), "total", "assigned")


def _gtf_lines(spark, d):
    """The fixture's features as annotation text: GTF, every third GFF3, every seventh without gene id."""
    raw = fixtures._sql(spark, fixtures.FEATURES_SQL, "part", d)
    attrs = "CASE WHEN feat_ord % 7 = 0 THEN 'note \"x\";' WHEN feat_ord % 3 = 0 THEN concat('ID=e', feat_ord, ';gene_id=', gene_id, ';n=1') ELSE concat('tag \"t\"; gene_id \"', gene_id, '\";') END"
    kind = "CASE WHEN feat_ord % 4 = 0 THEN 'CDS' ELSE 'exon' END"
    return raw.select(F.expr(f"concat_ws('\\t', chrom, 'src', {kind}, f_start, f_end, '.', strand, '.', {attrs})").alias("value"), F.col("feat_ord").alias("line_ord"))


def gtf_attribute_parse(spark, d):
    return parse_lines(_gtf_lines(spark, d), "gene_id").select("line_ord", "chrom", "type", "start", "end", "strand", "gene_id")


def feature_type_select(spark, d):
    lines = _gtf_lines(spark, d)
    kind = choose_type("exon", detect_types(lines))
    ann = build_annotation(parse_lines(lines, "gene_id").where(F.col("type") == kind))
    return ann.features.select("feature_idx", "gene_ord", "gene_id", "line_ord")


def _from_bam(spark, d, fields=None):
    return read_bam(spark, fixtures.bam_files(spark, d), 1 << 18, fields)


def bam_round_trip(spark, d):
    """Records written as BAM and read at small splits."""
    idx = lambda c: F.col(c).cast("bigint").alias(c)
    return _from_bam(spark, d).select(idx("sample_idx"), "qname", idx("flags"), "chrom", "pos", idx("mapq"), "cigar", idx("nh"), "mate_chrom")


def bam_blocks(spark, d):
    rows = _from_bam(spark, d, ["qname", "flags", "pos", "blocks"]).select("qname", F.col("flags").cast("bigint").alias("flags"), "pos", F.explode("blocks").alias("b"))
    return rows.select("qname", "flags", "pos", F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end"))


def bam_gene_counts(spark, d):
    """Fragments of BAM files, which the head of the first tells to be paired."""
    paths, ann = fixtures.bam_files(spark, d), fixtures.annotation(spark, d)
    cfg = C(paired=detect_paired(paths[0]) if paths else False)
    counts = count_once(read_alignments(spark, paths, 1 << 18), ann.features, ann.chroms, cfg).counts
    return counts.join(ann.genes, F.col("target") == F.col("gene_ord")).select(F.col("sample_idx").cast("bigint").alias("sample_idx"), "gene_id", "n")


def bam_pairs(spark, d):
    """Fragments of BAM files, which their splits pair."""
    reads = classify(_from_bam(spark, d, COUNT_FIELDS), fixtures.annotation(spark, d).chroms, PAIRED)
    return mates_in_splits(candidates(reads, False)).select("qname", "kind", F.get("rec.blocks", F.lit(0))["start"].alias("rec_start"), F.coalesce(F.get("mate.blocks", F.lit(0))["start"], F.lit(0)).alias("mate_start"))


#: A region that spans several bins of an index.
REGION = "chr3:2501-30000"


def bam_region(spark, d):
    """Alignments over a region, of sorted files, by their indexes."""
    rows = read_region(spark, fixtures.bam_files(spark, d, by_place=True), REGION, 1 << 16, ["sample_idx", "qname", "flags", "chrom", "pos", "cigar"])
    return rows.select(F.col("sample_idx").cast("bigint").alias("sample_idx"), "qname", F.col("flags").cast("bigint").alias("flags"), "chrom", "pos", "cigar")


def sam_round_trip(spark, d):
    idx = lambda c: F.col(c).cast("bigint").alias(c)
    rows = read_sam(spark, fixtures.sam_files(spark, d))
    return rows.select(idx("sample_idx"), "qname", idx("flags"), "chrom", "pos", idx("mapq"), "cigar", idx("nh"), "mate_chrom")


def sam_saf_gene_counts(spark, d):
    """Fragments of SAM files over the features of a SAF table."""
    ann = load_annotation(spark, fixtures.saf_file(spark, d), PAIRED)
    counts = count_once(read_alignments(spark, fixtures.sam_files(spark, d)), ann.features, ann.chroms, PAIRED).counts
    return counts.join(ann.genes, F.col("target") == F.col("gene_ord")).select(F.col("sample_idx").cast("bigint").alias("sample_idx"), "gene_id", "n")


def _numbered_lines(spark, path):
    """(line, text) of a file that a writer made; lines are numbered by ranges, so neither a task nor the driver has all."""
    return with_ordinal(read_lines(spark, path), "line", "line_ord").select(F.col("line").cast("bigint").alias("line"), F.col("value").alias("text"))


def _written(spark, d, cfg, write, name, schema, skip):
    """The lines of a file that a writer made, as rows of strings with their number."""
    result, ann = _run(spark, d, cfg)
    path = f"{shared_folder(spark)}/{name}"
    write(result, ann, path)
    fields, names = F.split("text", "\t", -1), [x.split()[0] for x in schema.split(", ")[1:]]
    return _numbered_lines(spark, path).where(F.col("line") >= skip).select((F.col("line") - skip).alias("line"), *[fields[i].alias(c) for i, c in enumerate(names)])


def count_table_file(spark, d):
    cfg = C(multi_mapping=True, fraction=True, multi_overlap=True)
    write = lambda result, ann, path: write_counts(result, ann, [("a", ""), ("b", "")], cfg, path, "x")
    return _written(spark, d, cfg, write, "counts", "line bigint, gene_id string, chr string, starts string, ends string, strands string, length string, a string, b string", 2)


def _lines_of(spark, d, cfg, name):
    """All lines of a count table as a writer made it, head and all, of a file that may be gzipped."""
    result, ann = _run(spark, d, cfg)
    path = f"{shared_folder(spark)}/{name}"
    write_counts(result, ann, [("a", ""), ("b", "")], cfg, path, "x")
    return _numbered_lines(spark, path)


def annotation_sniffed(spark, d):
    """A gzipped file without the default feature type: it is inflated, and CDS are taken instead."""
    features = load_annotation(spark, fixtures.gtf_file(spark, d), C()).features
    return features.select("feature_idx", "gene_ord", "gene_id", F.col("chrom_ord").cast("bigint").alias("chrom_ord"), "chrom", "start", "end", "strand")


def details_file(spark, d):
    """Each fragment's outcome, as written to Parquet."""
    path = f"{shared_folder(spark)}/details"
    write_details(_run(spark, d, C(multi_overlap=True, min_overlap=5))[0], path)
    idx = F.col("sample_idx").cast("bigint").alias("sample_idx")
    return spark.read.parquet(path).select(idx, F.col("first_ord").alias("file_ord"), "qname", "status", F.size("targets").cast("bigint").alias("n_targets"))


def feature_table_gzip(spark, d):
    return _lines_of(spark, d, C(feature_level=True, multi_overlap=True), "counts.gz")


def gene_table_lines(spark, d):
    return _lines_of(spark, d, C(strand=2), "counts.txt")


def exon_table_file(spark, d):
    cfg = C(output_format="dexseq")
    write = lambda result, ann, path: write_counts(result, ann, [("a", ""), ("b", "")], cfg, path, "x")
    return _written(spark, d, cfg, write, "counts", "line bigint, gene_id string, exon_id string, a string, b string", 1)


def summary_file(spark, d):
    write = lambda result, ann, path: write_summary(spark, result.status, path.removesuffix("summary") + "txt")
    return _written(spark, d, PAIRED, write, "counts.summary", "line bigint, status string, n string, pct string", 1)


PLAIN: dict[str, Query] = {
    "bam_round_trip": bam_round_trip, "bam_blocks": bam_blocks, "bam_gene_counts": bam_gene_counts, "bam_pairs": bam_pairs, "bam_region": bam_region,
    "sam_round_trip": sam_round_trip, "sam_saf_gene_counts": sam_saf_gene_counts,
    "count_table_file": count_table_file, "exon_table_file": exon_table_file, "feature_table_gzip": feature_table_gzip, "gene_table_lines": gene_table_lines, "annotation_sniffed": annotation_sniffed, "details_file": details_file, "summary_file": summary_file,
    "read_filter_status": _filter_status(C()), "read_filter_status_strict": _filter_status(STRICT.with_(paired=True, both_aligned=True, no_chimeric=True)),
    "cigar_blocks": cigar_block_rows, "interval_join_hits": interval_join_hits, "hit_overlap_len": hit_overlap_len, "mate_pairing": mate_pairing, "orphans": orphans,
    "collapsed_gene_length": collapsed_gene_length, "gene_metadata": gene_metadata, "exon_numbering": exon_numbering, "count_matrix_pivot": count_matrix_pivot,
    "summary_table": summary_table, "sample_totals": sample_totals, "gtf_attribute_parse": gtf_attribute_parse, "feature_type_select": feature_type_select,
}

_FA = f"WITH features AS ({fixtures.FEATURES_SQL})"
_ALL = f"WITH features AS ({fixtures.FEATURES_SQL}), aln AS ({fixtures.ALIGNMENTS_SQL}), blk AS ({oracle.BLOCKS_SQL}), rb AS (SELECT a.qname, a.file_ord, a.chrom, a.pos+1+b.off AS b_start, a.pos+b.off+b.len AS b_end FROM aln a JOIN blk b USING (cigar))"
_HIT = "FROM rb JOIN features f ON f.chrom = rb.chrom AND rb.b_start <= f.f_end AND f.f_start <= rb.b_end"
_TYPE = "CASE WHEN feat_ord % 4 = 0 THEN 'CDS' ELSE 'exon' END"
_GENE = "CASE WHEN feat_ord % 7 = 0 THEN NULL ELSE gene_id END"
_ORD = "SELECT *, first_value(feat_ord) OVER (PARTITION BY chrom ORDER BY feat_ord) AS co, first_value(feat_ord) OVER (PARTITION BY gene_id ORDER BY feat_ord) AS go FROM"
_COUNT = lambda cfg: f"({oracle.counts_sql(cfg)})"

PLAIN_SQL: dict[str, str] = {
    "read_filter_status": _filter_sql(C()),
    "read_filter_status_strict": _filter_sql(STRICT.with_(paired=True, both_aligned=True, no_chimeric=True)),
    "cigar_blocks": f"{_ALL} SELECT qname, file_ord, chrom, b_start, b_end FROM rb",
    "interval_join_hits": f"{_ALL} SELECT file_ord, feat_ord, b_start {_HIT}",
    "hit_overlap_len": f"{_ALL} SELECT file_ord, feat_ord, CAST(sum(least(b_end, f_end) - greatest(b_start, f_start) + 1) AS BIGINT) AS overlap {_HIT} GROUP BY ALL",
    "mate_pairing": f"WITH {oracle.reads_sql(PAIRED)}, {oracle.frags_sql(PAIRED)} SELECT qname, fid AS rec, mate FROM frag WHERE kind = 'pair'",
    "orphans": f"WITH {oracle.reads_sql(PAIRED)}, {oracle.frags_sql(PAIRED)} SELECT qname, kind, fid AS rec FROM frag WHERE kind <> 'pair'",
    "collapsed_gene_length": f"{_FA} SELECT gene_id, CAST(count(DISTINCT b) AS BIGINT) AS length FROM (SELECT gene_id, unnest(range(f_start, f_end + 1)) AS b FROM features) GROUP BY gene_id",
    "gene_metadata": f"""{_FA}, o AS ({_ORD} features)
SELECT gene_id, string_agg(chrom, ';' ORDER BY co, f_start, feat_ord) AS chr, string_agg(CAST(f_start AS VARCHAR), ';' ORDER BY co, f_start, feat_ord) AS starts,
 string_agg(CAST(f_end AS VARCHAR), ';' ORDER BY co, f_start, feat_ord) AS ends, string_agg(strand, ';' ORDER BY co, f_start, feat_ord) AS strands FROM o GROUP BY gene_id""",
    "exon_numbering": f"""{_FA}, o AS ({_ORD} features), n AS {_COUNT(C(feature_level=True))}
SELECT feat_ord, gene_id, concat('E', lpad(CAST(row_number() OVER (PARTITION BY gene_id ORDER BY co, f_start, feat_ord) AS VARCHAR), 3, '0')) AS exon_id
FROM o WHERE feat_ord IN (SELECT feat_ord FROM n)""",
    "count_matrix_pivot": f"""{_FA}, n AS {_COUNT(C())}
SELECT gene_id, CAST(coalesce(sum(n) FILTER (sample_idx=0),0) AS BIGINT) AS s0, CAST(coalesce(sum(n) FILTER (sample_idx=1),0) AS BIGINT) AS s1
FROM (SELECT DISTINCT gene_id FROM features) LEFT JOIN n USING (gene_id) GROUP BY gene_id""",
    "summary_table": f"""WITH s AS ({oracle.status_sql(PAIRED)})
SELECT CAST(v.ord AS BIGINT) AS ord, v.status, CAST(coalesce(sum(n),0) AS BIGINT) AS n FROM (VALUES (0,'Assigned'),(1,'Unassigned_Unmapped'),(2,'Unassigned_Read_Type'),(3,'Unassigned_Singleton'),
(4,'Unassigned_MappingQuality'),(5,'Unassigned_Chimera'),(6,'Unassigned_FragmentLength'),(7,'Unassigned_Duplicate'),(8,'Unassigned_MultiMapping'),(9,'Unassigned_Secondary'),
(10,'Unassigned_NoFeatures'),(11,'Unassigned_Overlapping_Length'),(12,'Unassigned_Ambiguity')) v(ord,status) LEFT JOIN s USING (status) GROUP BY ALL""",
    "sample_totals": f"SELECT sample_idx, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (status='Assigned') AS BIGINT) AS assigned FROM ({oracle.status_sql(C())}) GROUP BY 1",
    "gtf_attribute_parse": f"{_FA} SELECT feat_ord AS line_ord, chrom, {_TYPE} AS type, f_start AS start, f_end AS \"end\", strand, {_GENE} AS gene_id FROM features",
    "feature_type_select": f"""{_FA}, r AS (SELECT * FROM features WHERE {_TYPE} = 'exon'), c AS (SELECT chrom, min(feat_ord) AS co FROM r GROUP BY 1),
k AS (SELECT * FROM r WHERE {_GENE} IS NOT NULL), g AS (SELECT gene_id, row_number() OVER (ORDER BY min(feat_ord)) - 1 AS gene_ord FROM k GROUP BY 1)
SELECT row_number() OVER (ORDER BY co, f_start, feat_ord) - 1 AS feature_idx, gene_ord, gene_id, feat_ord AS line_ord FROM k JOIN c USING (chrom) JOIN g USING (gene_id)""",
}

_HEAD = "h(line, text) AS (VALUES (0::BIGINT, '# x'), (1::BIGINT, concat_ws(chr(9), 'Geneid', 'Chr', 'Start', 'End', 'Strand', 'Length', 'a', 'b')))"
_FRACTION = C(multi_mapping=True, fraction=True, multi_overlap=True)
PLAIN_SQL |= {
    "sam_round_trip": f"SELECT CAST(sample_idx AS BIGINT) AS sample_idx, qname, CAST(flags AS BIGINT) AS flags, chrom, pos, CAST(mapq AS BIGINT) AS mapq, cigar, CAST(nh AS BIGINT) AS nh, mate_chrom FROM ({fixtures.ALIGNMENTS_SQL})",
    "bam_round_trip": f"SELECT CAST(sample_idx AS BIGINT) AS sample_idx, qname, CAST(flags AS BIGINT) AS flags, chrom, pos, CAST(mapq AS BIGINT) AS mapq, cigar, CAST(nh AS BIGINT) AS nh, mate_chrom FROM ({fixtures.ALIGNMENTS_SQL})",
    "bam_blocks": f"WITH aln AS ({fixtures.ALIGNMENTS_SQL}), blk AS ({oracle.BLOCKS_SQL}) SELECT qname, CAST(flags AS BIGINT) AS flags, pos, pos+1+off AS b_start, pos+off+len AS b_end FROM aln JOIN blk USING (cigar)",
    "bam_gene_counts": oracle.counts_sql(PAIRED), "sam_saf_gene_counts": oracle.counts_sql(PAIRED),
    "bam_pairs": f"WITH {oracle.reads_sql(PAIRED)}, {oracle.frags_sql(PAIRED)} SELECT f.qname, kind, a.pos + 1 AS rec_start, coalesce(b.pos + 1, 0) AS mate_start FROM frag f JOIN cls a ON a.file_ord = fid LEFT JOIN cls b ON b.file_ord = mate",
    "bam_region": f"""WITH aln AS ({fixtures.ALIGNMENTS_SQL}), blk AS ({oracle.BLOCKS_SQL}), x AS (SELECT cigar, max(off + len) AS reach FROM blk GROUP BY 1)
SELECT CAST(sample_idx AS BIGINT) AS sample_idx, qname, CAST(flags AS BIGINT) AS flags, chrom, pos, cigar FROM aln JOIN x USING (cigar) WHERE chrom = 'chr3' AND pos < 30000 AND pos + reach > 2500""",
    "count_table_file": f"""{_FA}, n AS {_COUNT(_FRACTION)}, o AS (SELECT gene_id, min(feat_ord) AS o FROM features GROUP BY 1), m AS ({PLAIN_SQL["gene_metadata"]}), l AS ({PLAIN_SQL["collapsed_gene_length"]}),
p AS (SELECT gene_id, coalesce(sum(n) FILTER (sample_idx=0),0) AS a, coalesce(sum(n) FILTER (sample_idx=1),0) AS b FROM o LEFT JOIN n USING (gene_id) GROUP BY gene_id)
SELECT row_number() OVER (ORDER BY o.o) - 1 AS line, gene_id, chr, starts, ends, strands, CAST(length AS VARCHAR) AS length, printf('%.6f', CAST(a AS DOUBLE) / 1000000) AS a, printf('%.6f', CAST(b AS DOUBLE) / 1000000) AS b
FROM o JOIN m USING (gene_id) JOIN l USING (gene_id) JOIN p USING (gene_id)""",
    "annotation_sniffed": f"""{_FA}, r AS (SELECT * FROM features WHERE feat_ord % 4 <> 0), c AS (SELECT chrom, row_number() OVER (ORDER BY min(feat_ord)) - 1 AS chrom_ord FROM r GROUP BY 1),
g AS (SELECT gene_id, row_number() OVER (ORDER BY min(feat_ord)) - 1 AS gene_ord FROM r GROUP BY 1)
SELECT row_number() OVER (ORDER BY chrom_ord, f_start, feat_ord) - 1 AS feature_idx, gene_ord, gene_id, chrom_ord, chrom, f_start AS start, f_end AS "end", strand FROM r JOIN c USING (chrom) JOIN g USING (gene_id)""",
    "details_file": f"WITH {oracle.resolved_sql(C(multi_overlap=True, min_overlap=5))} SELECT CAST(res.sample_idx AS BIGINT) AS sample_idx, fid AS file_ord, qname, res.status, CAST(n_targets AS BIGINT) AS n_targets FROM res JOIN cls ON file_ord = fid",
    "feature_table_gzip": f"""{_FA}, o AS ({_ORD} features), n AS {_COUNT(C(feature_level=True, multi_overlap=True))}, {_HEAD},
p AS (SELECT feat_ord, coalesce(sum(n) FILTER (sample_idx=0),0) AS a, coalesce(sum(n) FILTER (sample_idx=1),0) AS b FROM features LEFT JOIN n USING (feat_ord) GROUP BY feat_ord)
SELECT line, text FROM h UNION ALL
SELECT row_number() OVER (ORDER BY co, f_start, feat_ord) + 1, concat_ws(chr(9), gene_id, chrom, f_start, f_end, strand, f_end - f_start + 1, a, b) FROM o JOIN p USING (feat_ord)""",
    "gene_table_lines": f"""{_FA}, n AS {_COUNT(C(strand=2))}, {_HEAD}, o AS (SELECT gene_id, min(feat_ord) AS o FROM features GROUP BY 1), m AS ({PLAIN_SQL["gene_metadata"]}), l AS ({PLAIN_SQL["collapsed_gene_length"]}),
p AS (SELECT gene_id, coalesce(sum(n) FILTER (sample_idx=0),0) AS a, coalesce(sum(n) FILTER (sample_idx=1),0) AS b FROM o LEFT JOIN n USING (gene_id) GROUP BY gene_id)
SELECT line, text FROM h UNION ALL
SELECT row_number() OVER (ORDER BY o.o) + 1, concat_ws(chr(9), gene_id, chr, starts, ends, strands, length, a, b) FROM o JOIN m USING (gene_id) JOIN l USING (gene_id) JOIN p USING (gene_id)""",
    "exon_table_file": f"""{_FA}, o AS ({_ORD} features), n AS {_COUNT(C(feature_level=True))}, p AS (SELECT feat_ord, coalesce(sum(n) FILTER (sample_idx=0),0) AS a, coalesce(sum(n) FILTER (sample_idx=1),0) AS b FROM n GROUP BY feat_ord)
SELECT row_number() OVER (ORDER BY co, f_start, feat_ord) - 1 AS line, gene_id, concat(gene_id, ':E', lpad(CAST(row_number() OVER (PARTITION BY gene_id ORDER BY co, f_start, feat_ord) AS VARCHAR), 3, '0')) AS exon_id,
 CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b FROM o JOIN p USING (feat_ord)""",
    "summary_file": f"SELECT ord AS line, status, CAST(n AS VARCHAR) AS n, printf('%.2f%%', 100.0 * n / sum(n) OVER ()) AS pct FROM ({PLAIN_SQL['summary_table']})",
}


def queries() -> dict[str, Query]:
    return PLAIN | {k: _counts(c) for k, c in COUNTS.items()} | {k: _status(c) for k, c in STATUS.items()}


def oracle_sql() -> dict[str, str]:
    return PLAIN_SQL | {k: oracle.counts_sql(c) for k, c in COUNTS.items()} | {k: oracle.status_sql(c) for k, c in STATUS.items()}
