"""BAM indexes (.bai): which parts of a coordinate-sorted file hold the alignments of a region."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: widths of the bins of each level, finest first, as shifts; the first bin of each; the bin that holds no alignments; shift of the linear index.
SHIFTS, FIRST_BINS, META_BIN, LINEAR = (14, 17, 20, 23, 26, 29), (4681, 585, 73, 9, 1, 0), 37450, 14
MAGIC = b"BAI\x01"


def smallest_bin(begin: int, end: int) -> int:
    """The bin of the interval [begin, end), 0-based: the first level, from the finest, of which one bin holds it all."""
    return next((first + (begin >> shift) for shift, first in zip(SHIFTS, FIRST_BINS, strict=True) if begin >> shift == (max(end, begin + 1) - 1) >> shift), 0)


def bins_over(begin: int, end: int) -> list[range]:
    """The bins, level by level, that overlap [begin, end)."""
    return [range(first + (begin >> shift), first + ((end - 1) >> shift) + 1) for shift, first in zip(SHIFTS, FIRST_BINS, strict=True)]


@dataclass
class ContigIndex:
    """Chunks, as pairs of virtual offsets, by bin; and by window the least offset of what overlaps it."""

    bins: dict[int, list[tuple[int, int]]]
    linear: list[int]

    def chunks(self, begin: int, end: int) -> list[tuple[int, int]]:
        """Chunks with all alignments that overlap [begin, end), in file order; those that share a block are one."""
        least = self.linear[min(begin >> LINEAR, len(self.linear) - 1)] if self.linear else 0
        asked = (b for level in bins_over(begin, end) for b in (level if len(level) < len(self.bins) else filter(level.__contains__, self.bins)))
        found = sorted(c for b in asked for c in self.bins.get(b, ()) if c[1] > least)
        out: list[tuple[int, int]] = []
        for a, b in found:
            a = max(a, least)
            if out and a >> 16 <= out[-1][1] >> 16:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out


def parse_index(raw: bytes) -> list[ContigIndex]:
    """The index of each contig, in the order of the file's header."""
    if raw[:4] != MAGIC:
        raise ValueError("not a BAM index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        n, at, bins = struct.unpack_from("<i", raw, at)[0], at + 4, {}
        for _ in range(n):
            number, count = struct.unpack_from("<Ii", raw, at)
            flat = struct.unpack_from(f"<{2 * count}Q", raw, at + 8)
            at += 8 + 16 * count
            if number != META_BIN:
                bins[number] = list(zip(flat[::2], flat[1::2], strict=True))
        n = struct.unpack_from("<i", raw, at)[0]
        out.append(ContigIndex(bins, list(struct.unpack_from(f"<{n}Q", raw, at + 4))))
        at += 4 + 8 * n
    return out


@dataclass
class IndexEntries:
    """What an index says of some alignments: rows of contig, bin and a chunk's first and last offset; rows of contig, the last window that alignments reach, and the least offset of these."""

    chunks: np.ndarray
    windows: np.ndarray


def _bins(begin: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``smallest_bin`` of many intervals, by their first and last place."""
    out = np.zeros(len(begin), np.int64)
    for shift, first in zip(SHIFTS[::-1], FIRST_BINS[::-1], strict=True):  # the finest that holds an interval stays
        out = np.where(begin >> shift == last >> shift, first + (begin >> shift), out)
    return out


def _joined(chunks: np.ndarray) -> np.ndarray:
    """Chunks of each bin in file order, with those that share a block as one."""
    chunks = chunks[np.lexsort((chunks[:, 2], chunks[:, 1], chunks[:, 0]))]
    same = (chunks[1:, :2] == chunks[:-1, :2]).all(1) & (chunks[1:, 2] >> 16 <= chunks[:-1, 3] >> 16)
    starts = np.flatnonzero(np.append(True, ~same)[: len(chunks)])
    return np.column_stack((chunks[starts, :3], chunks[np.append(starts[1:], len(chunks)) - 1, 3] if len(starts) else chunks[:0, 3]))


def index_entries(contig: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, after: np.ndarray) -> IndexEntries:
    """Entries of alignments in file order: contig number (below 0: none), begin, end, virtual offset and that of the next record."""
    known = contig >= 0
    contig, begin, last, at, after = (x[known] for x in (contig, begin, np.maximum(end, begin + 1) - 1, at, after))
    reached, first = np.unique(np.column_stack((contig, last >> LINEAR)), axis=0, return_index=True)
    return IndexEntries(_joined(np.column_stack((contig, _bins(begin, last), at, after))), np.column_stack((reached, at[first])))


def index_bytes(contigs: int, parts: list[tuple[int, IndexEntries]]) -> bytes:
    """The index file of a sorted file in parts: each one's first byte, and its entries by offsets from there on."""
    moved = lambda rows, at, columns: rows + (np.isin(np.arange(rows.shape[1]), columns) * (at << 16))
    chunks = _joined(np.concatenate([moved(e.chunks, at, (2, 3)) for at, e in parts] or [np.zeros((0, 4), np.int64)]))
    windows = np.concatenate([moved(e.windows, at, (2,)) for at, e in parts] or [np.zeros((0, 3), np.int64)])
    out = [MAGIC, struct.pack("<i", contigs)]
    for c in range(contigs):
        mine = chunks[chunks[:, 0] == c]
        numbers, starts = np.unique(mine[:, 1], return_index=True)
        out.append(struct.pack("<i", len(numbers)))
        for number, rows in zip(numbers.tolist(), np.split(mine[:, 2:].astype("<u8"), starts[1:]), strict=False):
            out += [struct.pack("<Ii", number, len(rows)), rows.tobytes()]
        reached = windows[windows[:, 0] == c]
        least = np.full(int(reached[:, 1].max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, reached[:, 1], reached[:, 2])
        least = np.minimum.accumulate(least[::-1])[::-1]  # a window without own alignments takes what follows
        out += [struct.pack("<i", len(least)), least.astype("<u8").tobytes()]
    return b"".join(out)


def build_index(contigs: int, alignments: Iterable[tuple[int, int, int, int, int]]) -> bytes:
    """The index file of a sorted file's alignments: (contig, begin, end, virtual offset, that of the next record)."""
    rows = np.array(list(alignments), np.int64).reshape(-1, 5)
    return index_bytes(contigs, [(0, index_entries(*rows.T))])


def parts_of(chunks: list[tuple[int, int]], split: int) -> list[tuple[int, int, int | None]]:
    """(first byte, end byte, offset of the first record in its block, or None: to be found) of pieces of about ``split`` bytes."""
    out = []
    for a, b in chunks:
        start, end = a >> 16, (b >> 16) + 1
        out += [(x, min(x + split, end), a & 0xFFFF if x == start else None) for x in range(start, end, split)]
    return out

