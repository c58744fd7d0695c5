"""Features as sorted arrays, which every executor has once, and fragments resolved against them row by row.

Features are classed by length: class k holds those of at most STEP**k times the width of a
bin. Each is held once, in the order of contig and start. Whatever of a class overlaps a block begins
no further before it than the class's longest feature is long, so it stands in one slice of the
class, found by two binary searches; a chromosome-long feature lengthens no other class's slices.
All fragments of an Arrow batch are looked up together. Nothing is exploded, joined or shuffled:
what a fragment is assigned to is known in its own row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.config import CountConfig
from locusflow.operators.classify import STATUSES

#: Lengths of two neighbouring classes differ by this factor.
STEP = 8
#: Features that executors are sent at most: some 25 bytes each.
MOST_FEATURES = 8_000_000
#: Room for positions below a contig's number in one sort key.
_ROOM = 1 << 44


@dataclass
class FeatureArrays:
    """Columns of all features, class by class, each in the order of ``key``, contig and start; ``ends`` has where classes end."""

    contigs: list[str]
    key: np.ndarray
    start: np.ndarray
    end: np.ndarray
    strand: np.ndarray
    target: np.ndarray
    ends: list[int]

    def hits(self, contig: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, feature) of all overlaps of blocks, whose contig is a number (-1: none), with features."""
        known = np.flatnonzero((contig >= 0) & (start <= end))
        base, blocks, found = contig[known] * _ROOM, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip([0, *self.ends], self.ends, strict=False):
            longest = int((self.end[a:b] - self.start[a:b]).max())
            lo = a + np.searchsorted(self.key[a:b], base + np.maximum(start[known] - longest, 0))
            n = np.maximum(a + np.searchsorted(self.key[a:b], base + end[known], side="right") - lo, 0)
            feature = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            block = np.repeat(known, n)
            meets = self.end[feature] >= start[block]
            blocks.append(block[meets])
            found.append(feature[meets])
        return np.concatenate(blocks), np.concatenate(found)


def collect_features(features: DataFrame, cfg: CountConfig) -> FeatureArrays | None:
    """The arrays of ``features``; None if there are more than executors should be sent.

    For genes, exons that several transcripts share count once. Features without any
    base (start after end) are left out, as nothing overlaps them.
    """
    target = "feature_idx" if cfg.feature_level else "gene_ord"
    rows = features.where("start <= end").selectExpr("chrom", "start", "end", "CASE strand WHEN '+' THEN 1 WHEN '-' THEN 2 ELSE 0 END AS strand", f"CAST({target} AS BIGINT) AS target").distinct()
    table = rows.limit(MOST_FEATURES + 1).toArrow()
    if table.num_rows > MOST_FEATURES:
        return None
    named = table.column("chrom").combine_chunks().dictionary_encode()
    start, end, strand, target = (table.column(c).to_numpy() for c in ("start", "end", "strand", "target"))
    size, kind, width = end - start + 1, np.zeros(len(start), np.int64), cfg.bin_width
    while (size > width).any():
        kind += size > width
        width *= STEP
    key = named.indices.to_numpy().astype(np.int64) * _ROOM + np.maximum(start, 0)
    order = np.lexsort((target, end, key, kind))
    ends = np.cumsum(np.bincount(kind))
    arrays = (x[order] for x in (key, start, end, strand.astype(np.int8), target))
    return FeatureArrays(named.dictionary.to_pylist(), *arrays, [int(e) for e, n in zip(ends, np.bincount(kind), strict=True) if n])


@dataclass
class Blocks:
    """Aligned blocks of a batch's fragments, ordered by fragment."""

    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray


def blocks_in(column: pa.Array) -> Blocks:
    """The blocks of a list column; those of null rows are none."""
    pairs = pc.list_flatten(column)
    return Blocks(pc.list_parent_indices(column).to_numpy().astype(np.int64), *(pc.struct_field(pairs, c).to_numpy() for c in ("start", "end")))


def _group_sum(owner: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, x, n).astype(np.int64)


def assign(arrays: FeatureArrays, cfg: CountConfig, chrom: pa.Array, query: Blocks, every: Blocks, read_len: np.ndarray, wanted: list[np.ndarray]) -> tuple[np.ndarray, pa.ListArray]:
    """(status number, targets in order) of each fragment.

    ``query`` blocks are looked up, ``every`` block counts as overlap. ``wanted`` has
    strands, 1 or 2, of which a feature must have one (0: no mate); none wants any strand.
    """
    n = len(chrom)
    contig = pc.fill_null(pc.index_in(chrom, value_set=pa.array(arrays.contigs, pa.string())), -1).to_numpy().astype(np.int64)
    block, feature = arrays.hits(contig[query.owner], query.start, query.end)
    pair = np.unique(query.owner[block] * (len(arrays.start) + 1) + feature)  # two blocks may meet one feature
    owner, feature = pair // (len(arrays.start) + 1), pair % (len(arrays.start) + 1)
    if wanted:
        strand = arrays.strand[feature]
        fits = (strand == 0) | np.any([w[owner] == strand for w in wanted], axis=0)
        owner, feature = owner[fits], feature[fits]
    hit, good = np.bincount(owner, minlength=n) > 0, np.ones(len(owner), bool)
    if cfg.needs_overlap_length:
        count = np.bincount(every.owner, minlength=n)
        begin, many = (np.cumsum(count) - count)[owner], count[owner]
        row = np.repeat(np.arange(len(owner)), many)
        b = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        shared = np.minimum(every.end[b], arrays.end[feature[row]]) - np.maximum(every.start[b], arrays.start[feature[row]]) + 1
        overlap = _group_sum(row, np.maximum(shared, 0), len(owner))
        good = overlap >= cfg.min_overlap
        if cfg.frac_overlap > 0:
            whole = read_len[owner]
            good &= (whole > 0) & ~((overlap / np.maximum(whole, 1)).astype(np.float32) < np.float32(cfg.frac_overlap))
        if cfg.frac_overlap_feature > 0:
            good &= ~((overlap / (arrays.end[feature] - arrays.start[feature] + 1)).astype(np.float32) < np.float32(cfg.frac_overlap_feature))
        if cfg.multi_overlap and cfg.largest_overlap:
            top = np.full(n, -1)
            np.maximum.at(top, owner[good], overlap[good])
            good &= overlap == top[owner]
    room = int(arrays.target.max(initial=0)) + 1
    pair = np.unique(owner[good] * room + arrays.target[feature[good]])
    owner, target = pair // room, pair % room
    size = np.bincount(owner, minlength=n)
    if not cfg.multi_overlap and (size > 2).any():  # which of many is of no use then: the least and the greatest
        first = (np.cumsum(size) - size)[owner]
        at = np.arange(len(owner)) - first
        ends = (at == 0) | (at == size[owner] - 1)
        owner, target = owner[ends], target[ends]
        size = np.bincount(owner, minlength=n)
    number = {s: i for i, s in enumerate(STATUSES)}
    many = number["Assigned" if cfg.multi_overlap else "Unassigned_Ambiguity"]
    none = np.where(hit, number["Unassigned_Overlapping_Length"], number["Unassigned_NoFeatures"])
    status = np.where(size == 1, number["Assigned"], np.where(size > 1, many, none))
    return status, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(target, pa.int64()))


def wanted_strands(cfg: CountConfig, reads: list[pa.Array]) -> list[np.ndarray]:
    """Strands that features must have, for the record and its mate; 0 where there is no mate."""
    if not cfg.strand_mode:
        return []
    codes = pa.array([2, 1] if cfg.strand_mode == 1 else [1, 2], pa.int64())  # of reverse and of forward reads
    return [pc.fill_null(codes.take(pc.cast(pc.invert(x), pa.int64())), 0).to_numpy() for x in reads]


def name_statuses(status: np.ndarray, cfg: CountConfig, kind: pa.Array | None, dropped: pa.Array | None) -> pa.Array:
    """Statuses in words: a filter's before all, then an orphan's where both mates must be aligned."""
    if cfg.paired and cfg.both_aligned and kind is not None:
        status = np.where(pc.equal(kind, "orphan").to_numpy(zero_copy_only=False), STATUSES.index("Unassigned_Singleton"), status)
    words = pa.array(STATUSES, pa.string()).take(pa.array(status))
    return words if dropped is None else pc.coalesce(dropped, words)


def resolver(index, cfg: CountConfig, unhit: bool, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns ``names`` of batches of fragments: their own, or status, targets, filtered and paired, which are made.

    ``index`` is a broadcast of FeatureArrays. Without ``unhit`` only fragments with a hit are returned.
    """

    def work(batches):
        arrays = index.value
        for b in batches:
            query = blocks_in(b.column("query_blocks"))
            every = blocks_in(b.column("all_blocks")) if cfg.needs_overlap_length else query
            read_len = pc.fill_null(b.column("read_len"), 0).to_numpy() if cfg.needs_overlap_length else None
            strands = [b.column("reverse"), b.column("mate_reverse")] if cfg.strand_mode else []
            status, targets = assign(arrays, cfg, b.column("chrom"), query, every, read_len, wanted_strands(cfg, strands))
            dropped, kind = (b.column(c) if c in b.schema.names else None for c in ("dropped", "kind"))
            made = {"status": name_statuses(status, cfg, kind, dropped), "targets": targets}
            if dropped is not None:
                made["filtered"] = pc.is_valid(dropped)
            if kind is not None:
                made["paired"] = pc.equal(kind, "pair")
            out = pa.RecordBatch.from_arrays([made[c] if c in made else b.column(c) for c in names], names=names)
            yield out if unhit else out.filter(pc.not_equal(out.column("status"), "Unassigned_NoFeatures"))

    return work


def needed(cfg: CountConfig) -> list[str]:
    """What ``resolver`` reads of fragments besides the columns that it hands on."""
    return ["chrom", "query_blocks", *(["all_blocks", "read_len"] if cfg.needs_overlap_length else []), *(["reverse", "mate_reverse"] if cfg.strand_mode else []), *(["kind"] if cfg.paired else [])]


#: Types of the columns that ``resolver`` makes.
MADE = {"status": "string", "targets": "array<bigint>", "filtered": "boolean", "paired": "boolean"}


def resolve_in_rows(frags: DataFrame, index, cfg: CountConfig, unhit: bool, keep: list[str]) -> DataFrame:
    """``keep`` columns, nh, status, targets and, where reads that a filter took come along, ``filtered`` of ``fragments``."""
    marked = ["dropped"] if "dropped" in frags.columns else []
    rows = frags.select(*dict.fromkeys([*keep, "nh", *needed(cfg), *marked]))
    names = [*keep, "nh", "status", "targets", *(["filtered"] if marked else [])]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | MADE
    return rows.mapInArrow(resolver(index, cfg, unhit, names), ", ".join(f"`{c}` {kinds[c]}" for c in names))
