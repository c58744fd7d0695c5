"""The counting rules as DuckDB SQL, written apart from the Spark plans.

Aligned blocks come from a table of the fixture's six CIGARs, overlaps from a
plain range join, pairs from a self-join of numbered rows.
"""

from __future__ import annotations

from locusflow.config import CountConfig
from locusflow.plans.fixtures import ALIGNMENTS_SQL, FEATURES_SQL

BLOCKS_SQL = """SELECT * FROM (VALUES ('50M',0,50),('20M200N30M',0,20),('20M200N30M',220,30),('5S45M',0,45),
  ('20M2D28M',0,50),('20M3I27M',0,47),('25M600N25M',0,25),('25M600N25M',625,25)) v(cigar,off,len)"""


def reads_sql(c: CountConfig) -> str:
    known = "(SELECT chrom FROM features)"
    w = ["WHEN flags & 4 <> 0 THEN 'Unassigned_Unmapped'"]
    if c.primary:
        w.append("WHEN flags & 256 <> 0 OR flags & 2048 <> 0 THEN 'Unassigned_Secondary'")
    w.append(f"WHEN mapq < {c.min_mapq} THEN 'Unassigned_MappingQuality'")
    if c.ignore_dup:
        w.append("WHEN flags & 1024 <> 0 THEN 'Unassigned_Duplicate'")
    if not c.multi_mapping:
        w.append("WHEN nh > 1 THEN 'Unassigned_MultiMapping'")
    w.append(f"WHEN chrom NOT IN {known} THEN 'Unassigned_NoFeatures'")
    if c.paired and c.both_aligned:
        w.append("WHEN flags & 8 <> 0 THEN 'Unassigned_Singleton'")
    if c.paired and c.no_chimeric:
        w.append(f"WHEN flags & 8 = 0 AND mate_chrom <> chrom AND mate_chrom IN {known} THEN 'Unassigned_Chimera'")
    return f"""features AS ({FEATURES_SQL}), aln AS ({ALIGNMENTS_SQL}), blk AS ({BLOCKS_SQL}),
cls AS (SELECT *, CASE {' '.join(w)} END AS status FROM aln),
rb AS (SELECT a.file_ord, a.chrom, a.pos+1+b.off AS b_start, a.pos+b.off+b.len AS b_end, b.len FROM cls a JOIN blk b USING (cigar) WHERE status IS NULL)"""


def frags_sql(c: CountConfig) -> str:
    """fid, sample_idx, mate (file_ord or null), kind, nh."""
    if not c.paired:
        return "frag AS (SELECT file_ord AS fid, sample_idx, qname, CAST(NULL AS BIGINT) AS mate, 'single' AS kind, nh, chrom, flags, CAST(NULL AS INTEGER) AS mflags, CAST(NULL AS VARCHAR) AS mchrom FROM cls WHERE status IS NULL)"
    return """num AS (SELECT *, row_number() OVER (PARTITION BY sample_idx, qname ORDER BY file_ord) AS rn FROM cls WHERE status IS NULL AND flags & 8 = 0),
frag AS (
  SELECT b.file_ord AS fid, b.sample_idx, b.qname, a.file_ord AS mate, 'pair' AS kind, greatest(a.nh, b.nh) AS nh, b.chrom, b.flags, a.flags AS mflags, a.chrom AS mchrom
  FROM num a JOIN num b ON a.sample_idx=b.sample_idx AND a.qname=b.qname AND b.rn=a.rn+1 WHERE a.rn%2=1
  UNION ALL
  SELECT a.file_ord, a.sample_idx, a.qname, NULL, 'orphan', a.nh, a.chrom, a.flags, NULL, NULL FROM num a
  WHERE a.rn%2=1 AND NOT EXISTS (SELECT 1 FROM num b WHERE a.sample_idx=b.sample_idx AND a.qname=b.qname AND b.rn=a.rn+1)
  UNION ALL
  SELECT file_ord, sample_idx, qname, NULL, 'single', nh, chrom, flags, NULL, NULL FROM cls WHERE status IS NULL AND flags & 8 <> 0)"""


def resolved_sql(c: CountConfig) -> str:
    strand = "TRUE"
    if c.strand_mode:
        same, other = ("-", "+") if c.strand_mode == 1 else ("+", "-")
        want = lambda f: f"CASE WHEN {f} & 16 <> 0 THEN '{same}' ELSE '{other}' END"
        strand = f"(f.strand = '.' OR f.strand = {want('g.flags')} OR (g.mflags IS NOT NULL AND f.strand = {want('g.mflags')}))"
    fails = [f"ol < {c.min_overlap}"]
    if c.frac_overlap > 0:
        fails.append(f"CAST(ol AS FLOAT)/CAST(rlen AS FLOAT) < CAST({c.frac_overlap} AS FLOAT)")
    if c.frac_overlap_feature > 0:
        fails.append(f"CAST(ol AS FLOAT)/CAST(f_end-f_start+1 AS FLOAT) < CAST({c.frac_overlap_feature} AS FLOAT)")
    target = "CAST(feat_ord AS VARCHAR)" if c.feature_level else "gene_id"
    top = "JOIN (SELECT fid, max(ol) AS mx FROM scored WHERE NOT bad GROUP BY fid) m USING (fid) WHERE NOT bad AND ol = mx" if c.multi_overlap and c.largest_overlap else "WHERE NOT bad"
    single = "WHEN kind = 'orphan' THEN 'Unassigned_Singleton'" if c.paired and c.both_aligned else ""
    many = "Assigned" if c.multi_overlap else "Unassigned_Ambiguity"
    return f"""{reads_sql(c)}, {frags_sql(c)},
fb AS (SELECT g.fid, b.chrom, b.b_start, b.b_end FROM frag g JOIN rb b ON b.file_ord = g.fid UNION ALL
       SELECT g.fid, b.chrom, b.b_start, b.b_end FROM frag g JOIN rb b ON b.file_ord = g.mate),
rlen AS (SELECT file_ord AS fid, sum(len) AS rlen FROM rb GROUP BY file_ord),
hit AS (SELECT DISTINCT g.fid, f.feat_ord, f.gene_id, f.f_start, f.f_end FROM frag g JOIN fb ON fb.fid = g.fid AND fb.chrom = g.chrom
        JOIN features f ON f.chrom = fb.chrom AND fb.b_start <= f.f_end AND f.f_start <= fb.b_end WHERE {strand}),
scored0 AS (SELECT h.fid, h.feat_ord, h.gene_id, h.f_start, h.f_end, any_value(r.rlen) AS rlen,
        CAST(sum(greatest(0, least(fb.b_end, h.f_end) - greatest(fb.b_start, h.f_start) + 1)) AS BIGINT) AS ol
        FROM hit h JOIN fb USING (fid) JOIN rlen r USING (fid) GROUP BY ALL),
scored AS (SELECT *, {target} AS target, ({' OR '.join(fails)}) AS bad FROM scored0),
tgt AS (SELECT DISTINCT fid, target FROM scored {top}),
res AS (SELECT g.fid, g.sample_idx, g.nh, coalesce(t.n, 0) AS n_targets,
        CASE {single} WHEN t.n = 1 THEN 'Assigned' WHEN t.n > 1 THEN '{many}' WHEN s.fid IS NOT NULL THEN 'Unassigned_Overlapping_Length' ELSE 'Unassigned_NoFeatures' END AS status
        FROM frag g LEFT JOIN (SELECT fid, count(*) AS n FROM tgt GROUP BY fid) t USING (fid) LEFT JOIN (SELECT DISTINCT fid FROM scored) s USING (fid))"""


def counts_sql(c: CountConfig) -> str:
    w = "1000000 // greatest(1, nh * n_targets)" if c.fraction else "1"
    if c.feature_level:
        return f"WITH {resolved_sql(c)} SELECT CAST(sample_idx AS BIGINT) AS sample_idx, CAST(target AS BIGINT) AS feat_ord, CAST(sum({w}) AS BIGINT) AS n FROM res JOIN tgt USING (fid) WHERE status='Assigned' GROUP BY ALL"
    return f"WITH {resolved_sql(c)} SELECT CAST(sample_idx AS BIGINT) AS sample_idx, target AS gene_id, CAST(sum({w}) AS BIGINT) AS n FROM res JOIN tgt USING (fid) WHERE status='Assigned' GROUP BY ALL"


def status_sql(c: CountConfig) -> str:
    return f"""WITH {resolved_sql(c)}, st AS (SELECT sample_idx, status FROM cls WHERE status IS NOT NULL UNION ALL SELECT sample_idx, status FROM res)
SELECT CAST(sample_idx AS BIGINT) AS sample_idx, status, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY ALL"""
