"""A small BAM writer, so that the reader can be tested on known records."""

import re
import struct
import zlib

OPS = "MIDNSHP=X"


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(qname, flags, ref, pos, mapq, cigar, mref=-1, tags=b"", lseq=0):
    ops = [(int(n), OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    name = qname.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), mapq, 0, len(ops), flags, lseq, mref, -1, 0)
    body += name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + b"\0" * ((lseq + 1) // 2 + lseq) + tags
    return struct.pack("<i", len(body)) + body


def write(path, contigs, records, size=60_000, tail=True):
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(contigs))
    head += b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", 1 << 28) for c in contigs)
    data = head + b"".join(records)
    with open(path, "wb") as f:
        for i in range(0, len(data), size):
            f.write(block(data[i : i + size]))
        if tail:
            f.write(block(b""))
