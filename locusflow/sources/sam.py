"""SAM text as alignments, with the columns that BAM files give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions.flags import clamp_nh
from locusflow.sources.bam import open_input

#: Lines of a file's head that are looked at for its header and first records.
HEAD_BYTES = 1 << 20
#: Fields that a record has at least.
LEAST = 11


def head_lines(path: str, size: int = HEAD_BYTES) -> list[str]:
    """The whole lines among the first bytes of a text file; header lines are read however many there are."""
    with open_input(path) as f:
        raw = f.read(size)
        while len(more := f.read(size)) and raw.rstrip(b"\n").rpartition(b"\n")[2].startswith(b"@"):
            raw += more
    lines = raw.decode("utf-8", "replace").split("\n")
    return [x.rstrip("\r") for x in (lines[:-1] if len(raw) >= size and lines[-1] else lines) if x]


def header(path: str) -> tuple[dict[str, str], list[str]]:
    """(fields of the @HD line, contigs of the @SQ lines in order) of a SAM file."""
    first, contigs = {}, []
    for x in head_lines(path):
        tags = dict(t.split(":", 1) for t in x.split("\t")[1:] if ":" in t)
        if x.startswith("@HD\t"):
            first = tags
        elif x.startswith("@SQ\t") and "SN" in tags:
            contigs.append(tags["SN"])
    return first, contigs


def is_sam(path: str) -> bool:
    """Whether a file begins as SAM text does: with a header line, or with a record."""
    with open_input(path) as f:
        raw = f.read(4)
    if raw[:2] == b"\x1f\x8b":
        return False
    return raw[:1] == b"@" or any(len(x.split("\t")) >= LEAST for x in head_lines(path)[:1])


def detect_paired(path: str, n: int = 1000) -> bool:
    """Whether any of the first ``n`` records, or of those in the file's head, has the paired flag."""
    records = [x.split("\t") for x in head_lines(path) if not x.startswith("@")]
    return any(int(r[1]) & 1 for r in records[:n] if len(r) >= LEAST and r[1].isdigit())


def _tag(tags: Column, name: str) -> Column:
    """The value of an optional field, of any type; null if absent."""
    return F.nullif(F.regexp_extract(F.concat(F.lit("\t"), tags), rf"\t{name}:[A-Za-z]:([^\t]*)", 1), F.lit(""))


def _same_path(x: Column) -> Column:
    """A file's address in one spelling: Spark and Hadoop differ in slashes after the scheme and in escapes."""
    short = F.regexp_replace(x, "^file:/+", "file:/")
    return F.coalesce(F.try_url_decode(short), short)


def _qualified(spark: SparkSession, path: str) -> str:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()


def read_sam(spark: SparkSession, paths: list[str], tags: list[str] | None = None, samples: list[int] | None = None) -> DataFrame:
    """Records of text files, one sample each (numbered as ``samples`` says, or from 0): the fields of BAM files but blocks, and ``tags`` as columns of text.

    Spark cuts files into splits and reads lines. ``file_ord`` is the split's first byte and
    the line's number in its partition: a line has over one byte, so the numbers of a split end before
    the next one's first byte, and they rise in file order. Header lines and lines of fewer than eleven
    fields are no records. Names ``*`` are null, ``=`` is the record's contig. NH is held to
    1 to 65535, and 1 if absent or no whole number.
    """
    text = spark.read.option("lineSep", "\n").text(list(dict.fromkeys(paths)))  # a file may be several samples
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = text.select(F.regexp_replace("value", "\r$", "").alias("value"), place.alias("file_ord"), _same_path(F.col("_metadata.file_path")).alias("path"))
    names = spark.createDataFrame(list(zip(samples or range(len(paths)), [_qualified(spark, p) for p in paths], strict=True)), "known int, path string").withColumn("path", _same_path(F.col("path")))
    rows = lines.where(~F.col("value").startswith("@")).withColumn("f", F.split("value", "\t", 12)).where(F.size("f") >= LEAST)
    f = lambda i: F.col("f")[i]
    name = lambda x: F.when(x != "*", x)
    more = F.coalesce(F.get("f", F.lit(LEAST)), F.lit(""))
    nh = _tag(more, "NH").try_cast("int")
    own = F.coalesce("known", F.raise_error(F.concat(F.lit("no sample for "), F.col("path")))).alias("sample_idx")
    return rows.join(F.broadcast(names), "path", "left").select(  # one row a file
        own, "file_ord", f(0).alias("qname"), f(1).try_cast("int").alias("flags"), name(f(2)).alias("chrom"), (f(3).try_cast("bigint") - 1).alias("pos"),
        f(4).try_cast("int").alias("mapq"), f(5).alias("cigar"), clamp_nh(nh).alias("nh"), F.when(f(6) == "=", name(f(2))).otherwise(name(f(6))).alias("mate_chrom"),
        *[_tag(more, t).alias(t) for t in tags or []],
    )
