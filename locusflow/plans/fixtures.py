"""Annotation and alignments as views over the ``part`` and ``lineitem`` tables.

The mapping is plain SQL that Spark and DuckDB read alike; SQL checks use the
same text, so both engines count the same reads.
"""

from __future__ import annotations

import gzip
import pickle
import re
import struct
import uuid
import zlib
from collections.abc import Callable
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.sources.annotation import Annotation
from locusflow.sources.bam import ADVANCE, CIGAR_OPS, flat, open_input, open_output
from locusflow.sources.bam_index import IndexEntries, index_bytes, index_entries
from locusflow.sources.line_sink import COPY_BYTES
from locusflow.sources.shared import remove, shared_folder

FEATURES_SQL = """
SELECT p_partkey AS feat_ord, concat('chr', p_partkey % 20) AS chrom,
  CAST(FLOOR(p_partkey/20) AS BIGINT)*1000 + (p_partkey*37)%400 + 1 AS f_start,
  CAST(FLOOR(p_partkey/20) AS BIGINT)*1000 + (p_partkey*37)%400 + 1 + p_size*30 AS f_end,
  concat('G', p_partkey % 20, '_', CAST(FLOOR(FLOOR(p_partkey/20)/2) AS BIGINT)) AS gene_id,
  CASE WHEN p_partkey%5=0 THEN '.' WHEN p_partkey%2=1 THEN '+' ELSE '-' END AS strand
FROM part"""

ALIGNMENTS_SQL = """
SELECT l_orderkey * 1048576 + rn AS file_ord,
  CAST(l_orderkey % 2 AS INT) AS sample_idx,
  concat('q', l_orderkey, ':', CAST(FLOOR((l_linenumber-1)/2) AS BIGINT)) AS qname,
  1 + CASE WHEN CAST(ROUND(l_tax*100) AS INT)=8 AND l_linenumber=7 THEN 4 ELSE 0 END
    + CASE WHEN l_suppkey%10=3 AND l_linenumber IN (5,7) THEN 8 ELSE 0 END
    + CASE WHEN l_linenumber%2=0 THEN 16+128 ELSE 64 END
    + CASE WHEN l_returnflag='R' AND CAST(ROUND(l_discount*100) AS INT)>=8 THEN 256 ELSE 0 END
    + CASE WHEN l_linestatus='F' AND CAST(ROUND(l_tax*100) AS INT)=5 THEN 1024 ELSE 0 END
    + CASE WHEN l_returnflag='A' AND CAST(ROUND(l_discount*100) AS INT)=1 THEN 2048 ELSE 0 END AS flags,
  CASE WHEN l_orderkey%13=0 THEN 'chrUn'
       WHEN l_orderkey%17=0 AND l_linenumber%2=0 THEN concat('chr',(l_orderkey+1)%20)
       ELSE concat('chr',l_orderkey%20) END AS chrom,
  CASE WHEN l_orderkey%13=0 THEN 'chrUn'
       WHEN l_orderkey%17=0 AND l_linenumber%2=1 THEN concat('chr',(l_orderkey+1)%20)
       ELSE concat('chr',l_orderkey%20) END AS mate_chrom,
  CAST(FLOOR(l_orderkey/150) AS BIGINT)*1000 + (l_orderkey*53)%700
    + CASE WHEN l_linenumber%2=0 THEN 180 ELSE 0 END + l_linenumber*3 AS pos,
  CAST(l_quantity AS INT) AS mapq,
  CASE CAST(l_partkey%6 AS INT) WHEN 0 THEN '50M' WHEN 1 THEN '20M200N30M' WHEN 2 THEN '5S45M'
       WHEN 3 THEN '20M2D28M' WHEN 4 THEN '20M3I27M' ELSE '25M600N25M' END AS cigar,
  CASE CAST(ROUND(l_discount*100) AS INT) WHEN 10 THEN 3 WHEN 9 THEN 2 ELSE 1 END AS nh
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,
    l_extendedprice,l_discount,l_tax,l_shipdate,l_returnflag,l_linestatus) AS rn FROM lineitem)"""


def _sql(spark: SparkSession, sql: str, table: str, sf_dir: str, dealt: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    head, _, tail = sql.rpartition(f"FROM {table}")
    return spark.sql(head + "FROM {src}" + tail, src=dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet")))


#: Features are numbered in buckets of this many bases; as a shift.
BASES = 20


def annotation(spark: SparkSession, sf_dir: str) -> Annotation:
    """Features of ``part``, in the order that the annotation reader gives them, here without a job.

    A feature's number is its place in its bucket and the rows of all buckets before. The table is
    about evenly dense, so a bucket has some thousand rows, and one task only sees a row a bucket.
    A gene's number is its first feature's, so these rise as the reader's do, with gaps.
    """
    raw = _sql(spark, FEATURES_SQL, "part", sf_dir).withColumn("bucket", F.shiftright("f_start", BASES))
    spans = raw.groupBy("chrom", "bucket").agg(F.count("*").alias("n"), F.min("feat_ord").alias("o")).coalesce(1).withColumn("o", F.min("o").over(Window.partitionBy("chrom")))
    before = F.coalesce(F.sum("n").over(Window.orderBy("o", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("chrom", "bucket", (F.dense_rank().over(Window.orderBy("o")) - 1).cast("int").alias("chrom_ord"), before.alias("before"))
    first = F.min("feat_ord").over(Window.partitionBy("gene_id"))
    place = F.row_number().over(Window.partitionBy("chrom", "bucket").orderBy("f_start", "feat_ord")) - 1
    rows = raw.withColumn("gene_ord", first).withColumn("place", place).join(spans, ["chrom", "bucket"])
    features = rows.select(
        (F.col("before") + F.col("place")).alias("feature_idx"), "gene_ord", "gene_id", "chrom_ord", "chrom",
        F.col("f_start").alias("start"), F.col("f_end").alias("end"), "strand", F.col("feat_ord").alias("line_ord"),
    ).cache()  # fmt: skip  # as the reader keeps it: it grows with the genome, not with the reads
    return Annotation(features, features.select("gene_id", "gene_ord").distinct(), features.select("chrom", "chrom_ord").distinct())


def alignments(spark: SparkSession, sf_dir: str, *dealt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return _sql(spark, ALIGNMENTS_SQL, "lineitem", sf_dir, *dealt)


CONTIGS = [*(f"chr{i}" for i in range(20)), "chrUn"]


#: The fixed fields of a record, its size first; then, after name and operations, the NH tag behind a text and an array tag.
RECORD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("lname", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("nops", "<u2"), ("flags", "<u2"), ("lseq", "<i4"), ("mref", "<i4"), ("mpos", "<i4"), ("tlen", "<i4")])
TAGS = np.dtype([("before", "S21"), ("nh", "<i4")])
BEFORE_NH = b"MDZ50\0XBBs" + struct.pack("<I2h", 2, 1, 2) + b"NHi"


def contig_numbers(names: pa.Array) -> np.ndarray:
    found = pc.index_in(names, value_set=pa.array(CONTIGS))
    if found.null_count:
        raise ValueError("a contig is not in the header")
    return found.to_numpy().astype(np.int64)


def bam_records(b: pa.RecordBatch) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The alignments of a batch as BAM bytes, put together by numpy; of each its size, contig number, first place and the one after its last."""
    col = lambda c: b.column(c).to_numpy()
    name, cigar, n = b.column("qname"), b.column("cigar").dictionary_encode(), b.num_rows
    lname, kind = pc.binary_length(name).to_numpy().astype(np.int64), cigar.indices.to_numpy()
    spelled = [np.array([int(k) << 4 | CIGAR_OPS.index(o) for k, o in re.findall(f"([0-9]+)([{CIGAR_OPS}])", x)], "<u4") for x in cigar.dictionary.to_pylist()]
    reach = np.array([int((x >> 4)[np.isin(x & 15, ADVANCE)].sum()) for x in spelled])
    many = np.array([4 * len(x) for x in spelled])
    nops, tags_at = many[kind], RECORD.itemsize + lname + 1 + many[kind]
    size = tags_at + TAGS.itemsize
    fixed, tags = np.zeros(n, RECORD), np.empty(n, TAGS)
    fixed["size"], fixed["ref"], fixed["mref"], fixed["mpos"] = size - 4, contig_numbers(b.column("chrom")), contig_numbers(b.column("mate_chrom")), -1
    fixed["pos"], fixed["lname"], fixed["mapq"], fixed["nops"], fixed["flags"] = col("pos"), lname + 1, col("mapq"), nops // 4, col("flags")
    tags["before"], tags["nh"] = BEFORE_NH, col("nh")
    out, at = np.zeros(int(size.sum()), np.uint8), np.cumsum(size) - size
    out[at[:, None] + np.arange(RECORD.itemsize)] = fixed.view(np.uint8).reshape(n, -1)
    out[flat(at + RECORD.itemsize, lname)] = np.frombuffer(b"".join(name.cast(pa.binary()).to_pylist()), np.uint8)
    out[flat(at + RECORD.itemsize + lname + 1, nops)] = np.concatenate(spelled).view(np.uint8)[flat((np.cumsum(many) - many)[kind], nops)]
    out[(at + tags_at)[:, None] + np.arange(TAGS.itemsize)] = tags.view(np.uint8).reshape(n, -1)
    return out.tobytes(), size, fixed["ref"].astype(np.int64), col("pos"), col("pos") + reach[kind]


def bgzf_block(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class BamFile:
    """A BAM file, or a part of one, to which records are added; with what an index says of them if they come sorted by place."""

    SIZE = 60_000

    def __init__(self, path: str, head: bytes = b""):
        self.path, self.out, self.held, self.at, self.size, self.blocks, self.placed = path, open_output(path), bytearray(head), 0, len(head), [], []

    def _block(self, data: bytes) -> None:
        packed = bgzf_block(data)
        self.blocks.append(self.at)
        self.at += len(packed)
        self.out.write(packed)

    def add(self, record: bytes, contig: int, pos: int, reach: int) -> None:
        self.add_all(record, *(np.array([x]) for x in (len(record), contig, pos, pos + reach)))

    def add_all(self, records: bytes, size: np.ndarray, *place: np.ndarray) -> None:
        """``place`` is contig number, begin and end of each record; without it there will be no index."""
        if place:
            self.placed.append((*place, self.size + np.cumsum(size) - size))
        self.held += records
        self.size += len(records)
        whole = len(self.held) // self.SIZE * self.SIZE
        for i in range(0, whole, self.SIZE):
            self._block(bytes(self.held[i : i + self.SIZE]))
        del self.held[:whole]

    def end(self, tail: bytes = b"") -> IndexEntries:
        """What an index says of the records, by offsets from this file's first byte on."""
        if self.held:
            self._block(bytes(self.held))
        self.out.write(tail)
        self.out.close()
        blocks, none = np.array([*self.blocks, self.at]), np.zeros(0, np.int64)
        contig, begin, end, at = (np.concatenate(x) for x in zip(*self.placed, strict=True)) if self.placed else [none] * 4
        place = lambda u: blocks[u // self.SIZE] << 16 | u % self.SIZE
        return index_entries(contig, begin, end, place(at), place(np.append(at[1:], self.size)) if len(at) else none)

    def close(self, index: bool) -> None:
        entries = self.end(bgzf_block(b""))
        if index:
            write_index(self.path, [(0, entries)])


def write_index(path: str, parts: list[tuple[int, IndexEntries]]) -> None:
    with open_output(path + ".bai") as f:
        f.write(index_bytes(len(CONTIGS), parts))


class BamPart:
    """Part of a BAM file; ``end`` gives what the file's index says of it."""

    def __init__(self, path: str, by_place: bool):
        self.file, self.by_place = BamFile(path), by_place

    def add(self, rows: pa.RecordBatch) -> None:
        records, size, *place = bam_records(rows)
        self.file.add_all(records, size, *(place if self.by_place else ()))

    def end(self) -> bytes:
        return pickle.dumps(self.file.end())


class TextPart:
    """Part of a text file, of rows whose ``line`` has its line feed."""

    def __init__(self, path: str, packed: bool = False):
        self.raw = open_output(path)
        self.out = gzip.GzipFile(fileobj=self.raw, mode="wb") if packed else self.raw

    def add(self, rows: pa.RecordBatch) -> None:
        self.out.write("".join(rows.column("line").to_pylist()).encode())

    def end(self) -> bytes:
        for f in dict.fromkeys([self.out, self.raw]):
            f.close()
        return b""


def _sample_files(spark: SparkSession, rows: DataFrame, ending: str, part: Callable, head: bytes = b"", tail: bytes = b"", finish: Callable | None = None) -> list[str]:
    """One file a sample, written in parts; the paths by sample.

    Partitions of ``rows`` are ranges of the files' order and are sorted by sample. Each
    task writes a part of each sample that it has rows of, and then one task a sample puts
    the bytes of its parts together, a few MB at a time. ``finish`` gets the
    file's path and (first byte, what ``part`` said at its end) of all parts.
    """
    folder = shared_folder(spark)

    def write(batches):
        number, out, done = TaskContext.get().partitionId(), None, []
        for b in batches:
            ids = b.column("sample_idx").to_numpy()
            for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]):
                if lo < hi and (not done or done[-1]["sample_idx"] != ids[lo]):
                    if out is not None:
                        done[-1]["said"] = out.end()
                    done.append({"sample_idx": int(ids[lo]), "number": number, "name": uuid.uuid4().hex})
                    out = part(f"{folder}/parts/{done[-1]['name']}")
                if lo < hi:
                    out.add(b.slice(lo, hi - lo))
        if out is not None:
            done[-1]["said"] = out.end()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("sample_idx", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("said", pa.binary())]))

    def join(batches):
        found = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["sample_idx"], r["number"]))  # a row a part
        made = []
        for sample, parts in groupby(found, key=lambda r: r["sample_idx"]):
            made.append({"sample_idx": sample, "name": uuid.uuid4().hex})
            path, said = f"{folder}/{made[-1]['name']}.{ending}", []
            with open_output(path) as out:
                out.write(head)
                for r in parts:
                    said.append((out.tell(), r["said"]))
                    with open_input(f"{folder}/parts/{r['name']}") as f:
                        while data := f.read(COPY_BYTES):
                            out.write(data)
                out.write(tail)
            if finish is not None:
                finish(path, said)
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("sample_idx", pa.int32()), ("name", pa.string())]))

    parts = rows.mapInArrow(write, "sample_idx int, number int, name string, said binary")
    names = parts.repartition(spark.sparkContext.defaultParallelism, "sample_idx").mapInArrow(join, "sample_idx int, name string").orderBy("sample_idx").collect()
    remove(spark, f"{folder}/parts")
    return [f"{folder}/{r['name']}.{ending}" for r in names]


def ordered_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments in ranges of the order of each sample's file, by the one shuffle that numbers them as well."""
    return alignments(spark, sf_dir, lambda rows: rows.repartitionByRange("l_orderkey")).sortWithinPartitions("sample_idx", "file_ord")


def bam_files(spark: SparkSession, sf_dir: str, by_place: bool = False) -> list[str]:
    """The alignments as BAM files, one a sample, written by the executors into a shared folder; sorted by place they get an index."""
    head = b"BAM\x01" + struct.pack("<ii", 0, len(CONTIGS)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", 1 << 28) for c in CONTIGS)
    if by_place:
        order = ["sample_idx", F.array_position(F.array(*map(F.lit, CONTIGS)), F.col("chrom")), "pos", "file_ord"]
        rows = alignments(spark, sf_dir).repartitionByRange(*order).sortWithinPartitions(*order)
    else:
        rows = ordered_alignments(spark, sf_dir)
    finish = lambda path, said: write_index(path, [(at, pickle.loads(x)) for at, x in said])
    return _sample_files(spark, rows, "bam", lambda path: BamPart(path, by_place), bgzf_block(head), bgzf_block(b""), finish if by_place else None)


def sam_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """The alignments as SAM text, one file a sample."""
    head = "".join(["@HD\tVN:1.6\tSO:unsorted\n", *(f"@SQ\tSN:{c}\tLN:{1 << 28}\n" for c in CONTIGS)]).encode()
    mate = F.when(F.col("mate_chrom") == F.col("chrom"), "=").otherwise(F.col("mate_chrom"))
    fields = ["qname", "flags", "chrom", F.col("pos") + 1, "mapq", "cigar", mate, *map(F.lit, ("0", "0", "*", "*", "MD:Z:50")), F.concat(F.lit("NH:i:"), "nh")]
    rows = ordered_alignments(spark, sf_dir).select("sample_idx", F.concat(F.concat_ws("\t", *fields), F.lit("\n")).alias("line"))
    return _sample_files(spark, rows, "sam", TextPart, head)


def _feature_lines(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    """A line of text a feature, as those of one sample, in ranges of their order."""
    rows = _sql(spark, FEATURES_SQL, "part", sf_dir).repartitionByRange("feat_ord").sortWithinPartitions("feat_ord")
    return rows.select(F.lit(0).alias("sample_idx"), F.concat(line, F.lit("\n")).alias("line"))


def saf_file(spark: SparkSession, sf_dir: str) -> str:
    """The features as a SAF table."""
    rows = _feature_lines(spark, sf_dir, F.concat_ws("\t", "gene_id", "chrom", "f_start", "f_end", "strand"))
    return _sample_files(spark, rows, "saf", TextPart, b"GeneID\tChr\tStart\tEnd\tStrand\n")[0]


def gtf_file(spark: SparkSession, sf_dir: str) -> str:
    """The features as a GTF file without exons, three of four lines CDS and the others genes, gzipped part by part though its name does not say so."""
    line = "concat_ws('\\t', chrom, 'src', CASE WHEN feat_ord % 4 = 0 THEN 'gene' ELSE 'CDS' END, f_start, f_end, '.', strand, '.', concat('gene_id \"', gene_id, '\";'))"
    return _sample_files(spark, _feature_lines(spark, sf_dir, F.expr(line)), "data", lambda path: TextPart(path, True))[0]
