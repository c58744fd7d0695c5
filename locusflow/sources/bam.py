"""BAM files as a Spark data source (``format("bam")``), in Arrow batches.

A file is cut into byte ranges. A task begins at the first compressed block in
its range, finds the first record that begins in its blocks by the shape that
records must have, and reads all records that begin there, however far the last
one reaches. ``file_ord`` is the record's virtual offset (block offset << 16 | offset
in block), so it rises in file order however the file is cut. Records are told
apart one by one; their fields are decoded by numpy for a whole batch, and only
those that are asked for.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from locusflow.sources.bam_index import parse_index, parts_of

FIELDS = {
    "sample_idx": "int", "file_ord": "bigint", "qname": "string", "flags": "int", "chrom": "string", "pos": "bigint", "mapq": "int", "cigar": "string",
    "nh": "int", "mate_chrom": "string", "blocks": "array<struct<start:bigint,end:bigint>>",
}
#: What counting reads: all but the CIGAR text, whose blocks are made here.
COUNT_FIELDS = [c for c in FIELDS if c != "cigar"]
# CIGAR operation letters by code, those that advance on the reference, and those that a block grows by; sizes of tag types.
CIGAR_OPS = "MIDNSHP=X"
ADVANCE, GROW, SKIP = (0, 2, 3, 7, 8), (0, 2, 7, 8), 3
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_INTS = {"c": "<i1", "C": "<u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4"}
MIN_RECORD, CHAIN, MAX_BLOCK, MOST = 32, 5, 1 << 16, 1 << 28
#: Inflated bytes that are decoded at once, unless one record is longer.
BATCH = 4 << 20


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_input(path: str):
    """A seekable file of any file system that Arrow knows, or of the local one."""
    system, name = _file_system(path)
    return system.open_input_file(name)


def exists_input(path: str) -> bool:
    system, name = _file_system(path)
    return system.get_file_info(name).is_file


def open_output(path: str):
    """A new file there, in a folder that is made if it is missing."""
    system, name = _file_system(path)
    if "/" in name:
        system.create_dir(name.rpartition("/")[0] or "/", recursive=True)
    return system.open_output_stream(name, compression=None)


def read_block(f, at: int) -> tuple[bytes, int] | None:
    """The inflated BGZF block at byte ``at`` and the next block's place; None at the end or on a cut-off block."""
    f.seek(at)
    head = f.read(18)
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    f.seek(at + 12)
    fields, i, size = f.read(extra), 0, 0
    while i + 4 <= len(fields):
        n = struct.unpack_from("<H", fields, i + 2)[0]
        if fields[i : i + 2] == b"BC":
            size = struct.unpack_from("<H", fields, i + 4)[0] + 1
        i += 4 + n
    body = f.read(size - 12 - extra - 8) if size else b""
    if not size or len(body) < size - 20 - extra:
        return None
    try:
        return zlib.decompress(body, -15), at + size
    except zlib.error:
        return None


class Inflated:
    """Inflated bytes from a block on, in a window that moves along, with the virtual offset of any of them."""

    def __init__(self, f, at: int):
        self.f, self.next, self.buf, self.starts, self.blocks = f, at, bytearray(), [], []

    def need(self, upto: int) -> bool:
        """Whether the window has ``upto`` bytes, after reading on."""
        while len(self.buf) < upto:
            got = read_block(self.f, self.next)
            if got is None:
                return False
            self.starts.append(len(self.buf))
            self.blocks.append(self.next)
            self.buf += got[0]
            self.next = got[1]
        return True

    def ahead(self, upto: int, end: int) -> bool:
        """As ``need``, but of blocks that begin before byte ``end`` of the file."""
        while len(self.buf) < upto and self.next < end and self.need(len(self.buf) + 1):
            pass
        return len(self.buf) >= upto

    def get(self, at: int, n: int) -> bytes | None:
        return bytes(self.buf[at : at + n]) if self.need(at + n) else None

    def forget(self, before: int) -> None:
        """Drop the bytes before a place, which becomes place 0."""
        del self.buf[:before]
        kept = max((i for i, x in enumerate(self.starts) if x <= before), default=0)
        self.starts, self.blocks = [x - before for x in self.starts[kept:]], self.blocks[kept:]

    def own(self, end: int) -> int:
        """How many bytes of the window lie in blocks that begin before byte ``end`` of the file."""
        return next((s for s, b in zip(self.starts, self.blocks, strict=True) if b >= end), len(self.buf))

    def voffsets(self, at: np.ndarray) -> np.ndarray:
        starts, blocks = np.array(self.starts, np.int64), np.array(self.blocks, np.int64)
        i = np.searchsorted(starts, at, side="right") - 1
        return blocks[i] << 16 | (at - starts[i])


def read_header(f) -> tuple[list[str], int, Inflated]:
    """Contig names, the place after the header, and the window that starts with it."""
    s = Inflated(f, 0)
    if s.get(0, 4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack("<i", s.get(4, 4))[0]
    n, at, names = struct.unpack("<i", s.get(at, 4))[0], at + 4, []
    for _ in range(n):
        size = struct.unpack("<i", s.get(at, 4))[0]
        names.append(s.get(at + 4, size)[:-1].decode("utf-8", "replace"))
        at += 8 + size
    return names, at, s


def field(buf, at: np.ndarray | slice, offset: int, kind: str) -> np.ndarray:
    """A little-endian number at ``offset`` after each place, wherever it lies."""
    size = np.dtype(kind).itemsize
    every = np.ndarray((max(0, len(buf) - offset - size + 1),), kind, buffer=buf, offset=min(offset, max(0, len(buf) - size)), strides=(1,))
    return every[at].astype(np.int64)


def plausible(buf, at: np.ndarray | slice, contigs: int) -> tuple[np.ndarray, np.ndarray]:
    """Which places may begin a record by its fixed fields, and the record's size with its length field."""
    size, ref, pos, lname, ncig, lseq, mref, mpos = (field(buf, at, o, k) for o, k in ((0, "<i4"), (4, "<i4"), (8, "<i4"), (12, "<u1"), (16, "<u2"), (20, "<i4"), (24, "<i4"), (28, "<i4")))
    n = min(map(len, (size, ref, pos, lname, ncig, lseq, mref, mpos)))
    size, ref, pos, lname, ncig, lseq, mref, mpos = (x[:n] for x in (size, ref, pos, lname, ncig, lseq, mref, mpos))
    ok = (ref >= -1) & (ref < contigs) & (mref >= -1) & (mref < contigs) & (pos >= -1) & (mpos >= -1) & (lname > 0) & (lseq >= 0)
    ok &= (size >= MIN_RECORD + lname + 4 * ncig + (lseq + 1) // 2 + lseq) & (size <= MOST)
    return ok, size + 4


def begins_chain(s: Inflated, at: int, contigs: int) -> bool:
    """Whether CHAIN records in a row begin at ``at``, or all that the file still has."""
    one, n = slice(0, 1), 0
    while n < CHAIN:
        head = s.get(at, 36)
        if head is None:
            return n > 0  # less than a record is left
        ok, size = plausible(head, one, contigs)
        if not ok[0] or (name := s.get(at + 36, head[12])) is not None and (name[-1] or b"\0" in name[:-1]):
            return False
        if not s.need(at + int(size[0])):
            return n > 1  # the file is cut off inside a record
        at, n = at + int(size[0]), n + 1
    return True


def first_record(s: Inflated, contigs: int, end: int) -> int | None:
    """Place of the first record that begins in a block before byte ``end`` of the file; None: there is none.

    Every place is looked at, a window at a time, so records may be of any length. The first
    window is short, as most records are.
    """
    size = MAX_BLOCK
    while True:
        more = s.need(size)
        own, seen, size = s.own(end), len(s.buf), BATCH
        ok, _ = plausible(bytes(s.buf[: own + 36]), slice(0, own), contigs)
        for at in np.flatnonzero(ok).tolist():
            if begins_chain(s, at, contigs):
                return at
        if not more or own < seen - 36:  # chains that were looked at may have made the window longer
            return None
        s.forget(own - 36)


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def nh_tags(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Each record's NH tag held to [1, 65535]; 1 if absent, not whole, or after an unknown type.

    All records step from tag to tag together, so the work is a few passes of numpy.
    """
    out, at, rows = np.ones(len(begin), np.int64), begin.copy(), np.arange(len(begin))
    padded = np.concatenate((raw, np.zeros(16, np.uint8)))
    nul = np.flatnonzero(raw == 0)
    size_of = np.zeros(256, np.int64)
    for k, n in TAG_SIZES.items():
        size_of[ord(k)] = n
    while len(rows):
        go = at + 3 <= end[rows]
        rows, at = rows[go], at[go]
        kind = padded[at + 2]
        nh = (padded[at] == ord("N")) & (padded[at + 1] == ord("H"))
        for k, dtype in TAG_INTS.items():
            mine = nh & (kind == ord(k)) & (at + 3 + TAG_SIZES[k] <= end[rows])
            if mine.any():
                out[rows[mine]] = np.clip(field(padded, at[mine], 3, dtype), 1, 65535)
        step = size_of[kind]
        text = (kind == ord("Z")) | (kind == ord("H"))
        if text.any():
            i = np.searchsorted(nul, at[text] + 3)
            close = np.where(i < len(nul), nul[np.minimum(i, max(0, len(nul) - 1))] if len(nul) else 0, len(raw))
            step[text] = close - (at[text] + 3) + 1
        array = kind == ord("B")
        if array.any():
            unit, n = size_of[padded[at[array] + 3]] * (padded[at[array] + 3] != ord("A")), field(padded, at[array], 4, "<u4")
            step[array] = np.where((unit > 0) & (at[array] + 8 <= end[rows[array]]), 5 + unit * n, 0)
        go = ~nh & (step > 0)
        rows, at = rows[go], (at + 3 + step)[go]
    return out


def blocks_of(ops: np.ndarray, count: np.ndarray, pos: np.ndarray) -> pa.Array:
    """Aligned blocks, 1-based and inclusive, from all records' CIGAR operations; ``count`` of them a record."""
    code, n = ops & 15, (ops >> 4).astype(np.int64)
    row = np.repeat(np.arange(len(count)), count)
    ahead = np.cumsum(np.where(np.isin(code, ADVANCE), n, 0))
    first = np.cumsum(count) - count
    base = np.concatenate(([0], ahead))[first]
    skips = code == SKIP
    opens = skips.copy()
    opens[first[count > 0]] = True
    at = np.flatnonzero(opens)
    size = np.add.reduceat(np.where(np.isin(code, GROW), n, 0), at) if len(at) else np.zeros(0, np.int64)
    before = np.concatenate(([0], ahead))[at] + np.where(skips[at], n[at], 0) - base[row[at]]
    keep = (size > 0) & (pos[row[at]] >= 0)
    start = (pos[row[at]] + 1 + before)[keep]
    ends = np.concatenate(([0], np.cumsum(np.bincount(row[at][keep], minlength=len(count)))))
    pairs = pa.StructArray.from_arrays([pa.array(start), pa.array(start + size[keep] - 1)], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def cigar_texts(ops: np.ndarray, count: np.ndarray) -> pa.Array:
    """CIGAR strings; each different one is spelled once."""
    known, out, raw, at = {}, [], ops.astype("<u4").tobytes(), 0
    for n in (4 * count).tolist():
        key, at = raw[at : at + n], at + n
        if key not in known:
            known[key] = "".join(f"{o >> 4}{CIGAR_OPS[o & 15]}" for (o,) in struct.iter_unpack("<I", key) if o & 15 < len(CIGAR_OPS)) or "*"
        out.append(known[key])
    return pa.array(out, pa.string())


def string_array(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    data, ends = raw[flat(start, size)], np.concatenate(([0], np.cumsum(size)))
    if (data > 127).any():
        whole = data.tobytes()
        return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def decode(buf: bytes, at: np.ndarray, voffset: np.ndarray, sample: int, names: list[str], fields: list[str]) -> pa.RecordBatch:
    """The records at places ``at``; those too short for what they claim go."""
    size = field(buf, at, 0, "<i4")
    at, voffset, size = (x[size > MIN_RECORD] for x in (at, voffset, size))
    lname, ncig, lseq = field(buf, at, 12, "<u1"), field(buf, at, 16, "<u2"), field(buf, at, 20, "<i4")
    whole = MIN_RECORD + lname + 4 * ncig <= size
    at, voffset, size, lname, ncig, lseq = (x[whole] for x in (at, voffset, size, lname, ncig, lseq))
    raw, pos = np.frombuffer(buf, np.uint8), field(buf, at, 8, "<i4")
    ops_at = at + 4 + MIN_RECORD + lname
    ops = raw[flat(ops_at, 4 * ncig)].view("<u4")

    def contig(offset: int) -> pa.Array:
        i = field(buf, at, offset, "<i4")
        return pa.array([*names, None], pa.string()).take(pa.array(np.where((i >= 0) & (i < len(names)), i, len(names))))

    make = {
        "sample_idx": lambda: pa.array(np.full(len(at), sample, np.int32)), "file_ord": lambda: pa.array(voffset),
        "qname": lambda: string_array(raw, at + 4 + MIN_RECORD, np.maximum(lname - 1, 0)), "flags": lambda: pa.array(field(buf, at, 18, "<u2").astype(np.int32)),
        "chrom": lambda: contig(4), "pos": lambda: pa.array(pos), "mapq": lambda: pa.array(field(buf, at, 13, "<u1").astype(np.int32)), "cigar": lambda: cigar_texts(ops, ncig),
        "nh": lambda: pa.array(nh_tags(raw, np.minimum(ops_at + 4 * ncig + (lseq + 1) // 2 + lseq, at + 4 + size), at + 4 + size).astype(np.int32)),
        "mate_chrom": lambda: contig(24), "blocks": lambda: blocks_of(ops, ncig, pos),
    }
    return pa.RecordBatch.from_arrays([make[c]() for c in fields], names=fields)


@dataclass
class Range(InputPartition):
    sample: int
    path: str
    start: int
    end: int
    #: Where in its block the first record begins, if an index tells it.
    first: int | None = None


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    ranges: list[Range]

    @property
    def bytes(self) -> int:
        return sum(x.end - x.start for x in self.ranges)


def read_range(part: Range, fields: list[str]):
    """Batches of the records that begin in a range of a file; a cut-off last record is left out."""
    with open_input(part.path) as f:
        names, at, s = read_header(f)
        if part.first is not None:
            s, at = Inflated(f, part.start), part.first
        elif part.start:
            place = find_block(f, part.start, part.end)
            if place is None:
                return
            s = Inflated(f, place)
            at = first_record(s, len(names), part.end)
            if at is None:
                return
        more = True
        while more:
            s.ahead(at + BATCH, part.end)
            own, found = s.own(part.end), []
            while at < own:
                size = int.from_bytes(s.buf[at : at + 4], "little", signed=True) if s.need(at + 4) else 0
                if size <= 0 or not found and not s.need(at + 4 + size):
                    own = at  # the file ends here
                    break
                if at + 4 + size > len(s.buf):
                    break  # the next batch begins with it
                found.append(at)
                at += 4 + size
            more = at < own or own == len(s.buf) and s.need(at + 4)
            if found:
                places = np.array(found)
                yield decode(bytes(s.buf[:at]), places, s.voffsets(places), part.sample, names, fields)
            if more:
                s.forget(at)
                at = 0


@dataclass
class Region:
    """A stretch [begin, end) of a contig, 0-based; alignments that overlap it are wanted, and others may come along."""

    contig: str
    begin: int = 0
    end: int = 1 << 29

    @classmethod
    def parse(cls, text: str) -> Region:
        """``name`` or ``name:first-last``, 1-based and inclusive."""
        name, colon, span = text.rpartition(":")
        if not colon:
            return cls(text)
        first, _, last = span.replace(",", "").partition("-")
        return cls(name, int(first) - 1, int(last or first))


class BamReader(DataSourceReader):
    def __init__(self, options, fields: list[str]):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(";") if p]
        self.split, self.fields = int(options.get("splitbytes", options.get("splitBytes", 64 << 20))), fields
        self.region = Region.parse(options["region"]) if options.get("region") else None

    def _indexed(self, path: str) -> list[tuple[int, int, int | None]] | None:
        """Pieces of a file that hold the region, if there is one and the file has an index beside it."""
        if self.region is None or not exists_input(path + ".bai"):
            return None
        with open_input(path + ".bai") as f:
            contigs = parse_index(f.read())
        with open_input(path) as f:
            names = read_header(f)[0]
        r = self.region
        if r.contig not in names or r.begin >= r.end or names.index(r.contig) >= len(contigs):
            return []
        return parts_of(contigs[names.index(r.contig)].chunks(max(r.begin, 0), r.end), self.split)

    def partitions(self):
        out: list[Ranges] = []
        for i, p in enumerate(self.paths):
            pieces = self._indexed(p)
            if pieces is None:
                with open_input(p) as f:
                    n = f.size()
                pieces = [(a, min(n, a + self.split), None) for a in range(0, max(n, 1), self.split)]
            for x in pieces:  # an index may list many small ones
                if out and out[-1].bytes + x[1] - x[0] <= self.split:
                    out[-1].ranges.append(Range(i, p, *x))
                else:
                    out.append(Ranges([Range(i, p, *x)]))
        return out or [Ranges([])]

    def read(self, part: Ranges):
        for x in part.ranges:
            yield from read_range(x, self.fields)


def find_block(f, start: int, end: int) -> int | None:
    """The first BGZF block that begins in [start, end); blocks are shorter than MAX_BLOCK, so one begins soon."""
    f.seek(start)
    raw, i = f.read(min(end - start, 2 * MAX_BLOCK) + 4), -1
    while (i := raw.find(b"\x1f\x8b\x08\x04", i + 1)) >= 0 and start + i < end:
        got = read_block(f, start + i)
        if got and (got[1] >= f.size() or read_block(f, got[1]) is not None):
            return start + i
    return None


class BamDataSource(DataSource):
    """Options: ``paths`` (joined by ;) or load(path); ``splitBytes``, 64 MiB by default; ``fields`` (joined by ,), all by default.

    With ``region`` (name:first-last) only those parts of a file are read that its index, a
    file of its name with .bai behind, lists for it; alignments beside the region may come along.
    The region is an option and not taken from filters that Spark pushes down: Spark 4.1 keeps what
    a reader made of them for the whole DataFrame, whose next query, with other filters, would lose rows.
    """

    @classmethod
    def name(cls):
        return "bam"

    def fields(self) -> list[str]:
        return [c for c in (self.options.get("fields") or ",".join(FIELDS)).split(",") if c]

    def schema(self):
        return ", ".join(f"{c} {FIELDS[c]}" for c in self.fields())

    def reader(self, schema):
        return BamReader(self.options, self.fields())


def read_bam(spark, paths: list[str], split_bytes: int = 64 << 20, fields: list[str] | None = None):
    """Records of all ``paths``; only ``fields`` are decoded."""
    spark.dataSource.register(BamDataSource)
    return spark.read.format("bam").options(paths=";".join(paths), splitBytes=split_bytes, fields=",".join(fields or FIELDS)).load()


def read_region(spark, paths: list[str], region: str, split_bytes: int = 64 << 20, fields: list[str] | None = None):
    """Records that overlap ``region`` (name or name:first-last): those with a base, gap or intron there; one without aligned bases by its place.

    Of files with an index only the parts listed for the region are read; others are read as a whole.
    """
    spark.dataSource.register(BamDataSource)
    r, own = Region.parse(region), fields or list(FIELDS)
    use = [*dict.fromkeys([*own, "chrom", "pos", "blocks"])]
    rows = spark.read.format("bam").options(paths=";".join(paths), splitBytes=split_bytes, fields=",".join(use), region=region).load()
    last = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["end"])), F.col("pos") + 1)
    return rows.where((F.col("chrom") == r.contig) & (F.col("pos") < r.end) & (last > r.begin)).select(*own)


def detect_paired(path: str, n: int = 1000) -> bool:
    """Whether any of the first ``n`` records of a file has the paired flag; only the head of the file is read."""
    seen = 0
    for batch in read_range(Range(0, path, 0, 1 << 62), ["flags"]):
        flags = batch.column("flags").to_numpy()[: n - seen]
        seen += len(flags)
        if (flags & 1).any():
            return True
        if seen >= n:
            break
    return False
