"""GTF, GFF3 and SAF annotation into feature, gene and contig tables."""

from __future__ import annotations

import gzip
import io
from dataclasses import dataclass
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from locusflow.config import CountConfig
from locusflow.operators.ordinals import with_ordinal
from locusflow.sources.bam import open_input
from locusflow.sources.shared import written

DETECT_LINES = 10_000
#: Bytes of lines that a stream hands on at once.
LINE_BATCH = 1 << 20
# Feature types to fall back on, best first.
PREFERRED_TYPES = ("exon", "exonic_part", "CDS", "gene")
# Names of the second to fourth column of a SAF table.
SAF_NAMES = ("chr", "start", "end")


@dataclass
class Annotation:
    features: DataFrame
    genes: DataFrame
    chroms: DataFrame


def is_gzipped(path: str) -> bool:
    """Whether a file begins as gzip does; two bytes are read."""
    with open_input(path) as f:
        return f.read(2) == b"\x1f\x8b"


class LineReader(DataSourceReader):
    """Lines of one file as a stream: gzip cannot be cut, so one task inflates it batch by batch."""

    def __init__(self, options):
        self.path, self.packed = options["path"], options["packed"] == "true"

    def partitions(self):
        return [InputPartition(0)]

    def read(self, _):
        with open_input(self.path) as raw, gzip.GzipFile(fileobj=raw) if self.packed else io.BufferedReader(raw) as f:
            for b in count():
                lines = f.readlines(LINE_BATCH)
                if not lines:
                    return
                texts = pa.array([x.rstrip(b"\n").decode("utf-8", "replace") for x in lines], pa.string())
                places = pa.StructArray.from_arrays([pa.array([b] * len(lines), pa.int64()), pa.array(range(len(lines)), pa.int64())], names=["b", "i"])
                yield pa.RecordBatch.from_arrays([texts, places], names=["value", "line_ord"])


class LineSource(DataSource):
    """A text file that is gzipped, or is not, though its name says otherwise."""

    @classmethod
    def name(cls):
        return "annotation_lines"

    def schema(self):
        return "value string, line_ord struct<b:bigint,i:bigint>"

    def reader(self, schema):
        return LineReader(self.options)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_ord) of a text file, plain or gzipped; ``line_ord`` orders rows as the file does.

    Spark inflates by the file's name. Where its first bytes say otherwise, it is read as a stream.
    """
    packed = is_gzipped(path)
    if packed != path.endswith(".gz"):
        spark.dataSource.register(LineSource)
        text = spark.read.format("annotation_lines").option("packed", str(packed).lower()).load(path)
        return text.select(F.regexp_replace("value", "\r$", "").alias("value"), "line_ord")
    text = spark.read.option("lineSep", "\n").text(path)
    order = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return text.select(F.regexp_replace("value", "\r$", "").alias("value"), order.alias("line_ord"))


def leading_int(x: Column) -> Column:
    """Leading digits as a number; 0 without any."""
    return F.coalesce(F.regexp_extract(x, "^([0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute, GTF style (name "v") or else GFF3 style (name=v); null if absent.

    The first occurrence counts, even inside a longer name. A GTF value without
    closing quote is absent, and GFF3 style is not tried for it.
    """
    gtf, gff = f'{name} "', f"{name}="
    after = lambda needle: F.substring(attrs, F.instr(attrs, needle) + F.lit(len(needle)), F.length(attrs))
    quoted = after(gtf)
    gtf_value = F.when(F.instr(quoted, '"') > 0, F.substring_index(quoted, '"', 1))
    gff_value = F.substring_index(after(gff), ";", 1)
    return F.when(F.instr(attrs, gtf) > 0, gtf_value).when(F.instr(attrs, gff) > 0, gff_value)


def parse_lines(lines: DataFrame, gene_attribute: str) -> DataFrame:
    """Feature rows of annotation lines: comments, empty and short lines go."""
    kept = lines.where((F.length("value") > 0) & ~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t", -1)).where(F.size("f") >= 9)
    f = lambda i: F.col("f")[i]
    strand = F.when(f(6).startswith("+"), "+").when(f(6).startswith("-"), "-").otherwise(".")
    return kept.select(
        "line_ord", f(0).alias("chrom"), f(2).alias("type"), leading_int(f(3)).alias("start"), leading_int(f(4)).alias("end"),
        strand.alias("strand"), attribute(f(8), gene_attribute).alias("gene_id"),
    )


def _data_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither empty nor comments (``#``) nor headers (``@``)."""
    return lines.where((F.length("value") > 0) & ~F.col("value").startswith("#") & ~F.col("value").startswith("@"))


def is_saf(lines: DataFrame) -> bool:
    """Whether the first line of data is one of a SAF table: five to eight fields, of which the third and fourth are numbers, or the column names."""
    first = [r.value.split("\t") for r in _data_lines(lines).orderBy("line_ord").limit(1).collect()]
    if not first or not 5 <= len(first[0]) < 9:
        return False
    f = first[0]
    return f[2].isdigit() and f[3].isdigit() or [x.lower() for x in f[1:4]] == list(SAF_NAMES)


def parse_saf(lines: DataFrame) -> DataFrame:
    """Feature rows of a SAF table: gene id, contig, start, end, strand, 1-based and inclusive, in tab-separated columns.

    A line of column names, comments, headers and lines of fewer fields go; further fields are ignored.
    All rows are of the type ``exon``, an empty gene id is none, any strand but + and - is unknown.
    """
    kept = _data_lines(lines).withColumn("f", F.split("value", "\t", -1)).where(F.size("f") >= 5)
    f = lambda i: F.col("f")[i]
    named = F.lower(f(1)).eqNullSafe(SAF_NAMES[0]) & F.lower(f(2)).eqNullSafe(SAF_NAMES[1]) & F.lower(f(3)).eqNullSafe(SAF_NAMES[2])
    strand = F.when(f(4).isin("+", "-"), f(4)).otherwise(".")
    return kept.where(~named).select(
        "line_ord", f(1).alias("chrom"), F.lit("exon").alias("type"), leading_int(f(2)).alias("start"), leading_int(f(3)).alias("end"),
        strand.alias("strand"), F.nullif(f(0), F.lit("")).alias("gene_id"),
    )


def detect_types(lines: DataFrame, n: int = DETECT_LINES) -> list[str]:
    """Distinct feature types in the first ``n`` lines that are no comments, sorted."""
    head = lines.where((F.length("value") > 0) & ~F.col("value").startswith("#")).orderBy("line_ord").limit(n)
    parts = F.split("value", "\t", -1)
    return sorted(r[0] for r in head.where(F.size(parts) >= 4).select(parts[2]).distinct().collect())


def choose_type(wanted: str, present: list[str]) -> str:
    """The feature type to use; only the default may be replaced."""
    if wanted in present:
        return wanted
    if not present:
        raise ValueError("the annotation has no feature types")
    if wanted != "exon":
        raise ValueError(f"feature type {wanted!r} is not in the annotation; it has {', '.join(present)}")
    return next((t for t in PREFERRED_TYPES if t in present), present[0])


def build_annotation(rows: DataFrame) -> Annotation:
    """Number contigs and genes by first appearance and features by (contig, start, line).

    A contig counts as known even if none of its rows has a gene id. Each table is
    written once with its numbers, so no task has to hold a whole one. The rows are written
    before that, as they are gone through several times and their lines shall be parsed once.
    """
    rows = written(rows)
    chroms = with_ordinal(rows.groupBy("chrom").agg(F.min("line_ord").alias("o")), "chrom_ord", "o").select("chrom", F.col("chrom_ord").cast("int").alias("chrom_ord"))
    named = rows.where(F.col("gene_id").isNotNull())
    genes = with_ordinal(named.groupBy("gene_id").agg(F.min("line_ord").alias("o")), "gene_ord", "o").select("gene_id", "gene_ord")
    placed = named.join(chroms, "chrom").join(genes, "gene_id").select("gene_ord", "gene_id", "chrom_ord", "chrom", "start", "end", "strand", "line_ord")
    features = with_ordinal(placed, "feature_idx", "chrom_ord", "start", "line_ord").select("feature_idx", *placed.columns)
    return Annotation(features, genes, chroms)


def load_annotation(spark: SparkSession, path: str, cfg: CountConfig) -> Annotation:
    """The annotation in a file: GTF, GFF3 or, where its first line of data says so, SAF, which has no feature types."""
    lines = read_lines(spark, path)
    if is_saf(lines):
        found = build_annotation(parse_saf(lines))
    else:
        kind = choose_type(cfg.feature_type, detect_types(lines))
        found = build_annotation(parse_lines(lines, cfg.gene_attribute).where(F.col("type") == kind))
    return Annotation(found.features.cache(), found.genes.cache(), found.chroms.cache())
