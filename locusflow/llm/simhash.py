"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within distance 4 have a common variant within distance 2 of
both, and all fingerprints that share a variant within 2 lie within 4 of each
other. So every fingerprint emits its ball of variants of radius 2, and each group
of fingerprints on one variant becomes a star of links. Variants are shuffled by
their leading bits: the ball of a fingerprint touches few leading-bit cells, it is
sent to each of these once, and the task that owns a cell lists the variants in it.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from locusflow.llm.common import NO_ID, cut, documents, row_id, split_by_keys, texts, words_of
from locusflow.llm.components import connected_components

SHINGLE, SEED, BITS, RADIUS = 4, 42, 64, 2
#: Variants that a cell and a step of a task should hold, and bits by which a crowded cell is cut.
CELL_VARIANTS, STEP_VARIANTS, FINER = 8_000_000, 2_000_000, 8


def simhash(words: list[bytes]) -> int:
    """Majority of the bits of XXH64 over all word shingles; 0 without words."""
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        h = np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - SHINGLE] + 1)).tolist()
        parts = (joined[a:b] for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True))
        h = np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64, n - SHINGLE + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        piece = h[at : at + (1 << 16)]
        ones += np.unpackbits(piece.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, th, fp): id and hash of each row's whole text, and its 64-bit fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((simhash(words_of(t)) for t in texts(b)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(fp)], names=["id", "th", "fp"])

    return docs.select(*row_key(), "text").mapInArrow(run, "id long, th long, fp long")


def row_key(id_: str = "id", th: str = "th") -> tuple:
    """What tells a row: its id and the hash of its text."""
    return row_id(F.col("doc_id"), F.col("text")).alias(id_), F.xxhash64("text").alias(th)


@lru_cache(64)
def ball(low: int, high: int, radius: int) -> np.ndarray:
    """Masks of up to ``radius`` ones among bits low .. high-1."""
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(low, high), r)]
    return np.array(masks, np.uint64)


def cells_of(fps: np.ndarray, radius: np.ndarray, top: int, bits: int):
    """Where the balls of ``fps`` lie when bits top-bits .. top-1 are fixed: (row, cell bits, radius left)."""
    rows, cells, left = [], [], []
    for r in range(RADIUS + 1):
        at = np.flatnonzero(radius == r)
        if len(at):
            m = ball(top - bits, top, r)
            mask = np.uint64(((1 << bits) - 1) << (top - bits))
            rows.append(np.repeat(at, len(m)))
            cells.append(((fps[at, None] ^ m) & mask).ravel())
            left.append(np.tile(r - np.bitwise_count(m).astype(np.int64), len(at)))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (rows, cells, left))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star to the least node for each component of the links."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def links_in_cell(fps: np.ndarray, radius: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints whose balls share a variant in this cell; ``free`` low bits are open.

    A cell with too many variants for one step is cut by further bits, so memory
    is bounded however many fingerprints crowd together.
    """
    per = np.array([len(ball(0, free, r)) for r in range(RADIUS + 1)])
    none = np.zeros(0, np.uint64)
    if len(fps) < 2:
        return none, none
    if per[radius].sum() > STEP_VARIANTS and free > 0:
        bits = min(4, free)
        rows, cells, left = cells_of(fps, radius, free, bits)
        order = np.argsort(cells, kind="stable")
        rows, cells, left = rows[order], cells[order], left[order]
        found = [links_in_cell(fps[i], r, free - bits) for i, r in zip(*(np.split(x, np.flatnonzero(np.diff(cells)) + 1) for x in (rows, left)), strict=True)]
        a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
        return forest(a, b)
    low = np.uint64((1 << free) - 1)
    own, variants = [], []
    for r in range(RADIUS + 1):
        at = np.flatnonzero(radius == r)
        if len(at):
            m = ball(0, free, r)
            own.append(np.repeat(at, len(m)))
            variants.append(((fps[at, None] & low) ^ m).ravel())
    own, variants = np.concatenate(own), np.concatenate(variants)
    order = np.argsort(variants)
    own, variants = own[order], variants[order]
    same = np.flatnonzero(variants[1:] == variants[:-1])
    a, b = fps[own[same]], fps[own[same + 1]]
    near = np.bitwise_count(a ^ b) <= 2 * RADIUS
    return forest(a[near], b[near])


def radius_left(fps: np.ndarray, cells: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return RADIUS - np.bitwise_count((fps ^ cells) & mask).astype(np.int64)


def emit_cells(fps: np.ndarray, bits: int, crowded: list[np.ndarray]):
    """(fp, cell, bits of the cell) for all cells that a fingerprint's ball touches.

    ``crowded`` lists, step by step of FINER more bits, the cells that are cut finer.
    """
    rows, cells, left = cells_of(fps, np.full(len(fps), RADIUS), BITS, bits)
    out = []
    for hot_cells in [*crowded, np.zeros(0, np.uint64)]:
        hot = np.isin(cells, hot_cells)
        out.append((fps[rows[~hot]], cells[~hot], np.full((~hot).sum(), bits)))
        if not hot.any():
            break
        sub, fine, left = cells_of(fps[rows[hot]], left[hot], BITS - bits, FINER)
        rows, cells, bits = rows[hot][sub], cells[hot][sub] | fine, bits + FINER
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def crowded_cells(nodes: DataFrame, bits: int, limit: int) -> list[np.ndarray]:
    """Cells of leading bits with more than ``limit`` fingerprints, by steps of FINER bits until none is.

    Only crowded cells come to the driver: at most one for each ``limit`` fingerprints and step.
    """
    out, inside = [], nodes
    while bits + FINER <= BITS:
        shift = BITS - bits
        lead = F.shiftrightunsigned("fp", shift)
        cells = [r.c for r in inside.groupBy(lead.alias("c")).count().where(F.col("count") > limit).select("c").collect()]
        if not cells:
            break
        out.append(np.array([c << shift for c in cells], np.uint64))
        inside = inside.join(F.broadcast(nodes.sparkSession.createDataFrame([(c,) for c in cells], "c long")), lead == F.col("c"), "left_semi")
        bits += FINER
    return out


def near_links(nodes: DataFrame, n: int, cell_variants: int = CELL_VARIANTS) -> DataFrame:
    """Links (a, b) that connect all of ``n`` distinct fingerprints ``fp`` within distance 4 of each other.

    Not every pair: pairs that meet on a variant are checked for their distance, and
    each cell returns a forest over its pairs, at most one link per fingerprint in it.
    """
    per = len(ball(0, BITS, RADIUS))
    bits = min(24, max(2, int(np.ceil(np.log2(max(1, n) * per / cell_variants + 1)))))
    crowded = crowded_cells(nodes, bits, max(4 * n >> bits, 4 * cell_variants // per))

    def emit(batches):
        for b in batches:
            all_fps = b.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(all_fps), 4096):
                fp, cell, k = emit_cells(all_fps[at : at + 4096], bits, crowded)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp.view(np.int64), cell.view(np.int64), k.astype(np.int8))], names=["fp", "cell", "k"])

    def link(table: pa.Table) -> pa.Table:
        fps, k = table.column("fp").to_numpy().view(np.uint64), int(table.column("k")[0].as_py())
        mask = np.uint64(((1 << k) - 1) << (BITS - k))
        cell = np.uint64(table.column("cell")[0].as_py() & ((1 << BITS) - 1))
        a, b = links_in_cell(fps, radius_left(fps, cell, mask), BITS - k)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    sent = nodes.select("fp").mapInArrow(emit, "fp long, cell long, k byte")
    return sent.groupBy("cell", "k").applyInArrow(link, "a long, b long")


#: A component with very many fingerprints is joined in so many parts.
PARTS = 16


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, th, fp), and per distinct fp its component's survivor (fp, component, kept), the least id and its least th."""
    fps = cut(fingerprints(docs))
    nodes = cut(fps.groupBy("fp").agg(F.min(F.struct("id", "th")).alias("least")))
    roots = cut(connected_components(near_links(nodes.select("fp"), nodes.count())))
    linked = cut(nodes.join(roots, nodes.fp == roots.node).select("fp", "least", "root"))
    # Fingerprints without links are their own survivors; the others' are dealt in PARTS, as one root may have very many.
    best = linked.groupBy("root").agg(F.min("least").alias("best")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    named = linked.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int")).join(best, ["root", "part"]).select("fp", "best")
    alone = nodes.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("best"))
    return fps, cut(named.unionByName(alone).select("fp", F.col("best.id").alias("component"), F.col("best.th").alias("kept")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: id, fp and component, the least id of its group of near-duplicates.

    Copies are one node, however many there are. Null and empty texts have
    fingerprint 0, rows without doc_id are told by their text and never outrank
    real ids, repeated rows share a group, an empty table gives no rows. Ids are
    whole numbers, or texts of such.
    """
    fps, named = grouped(docs)
    return fps.join(named.select("fp", "component"), "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the least id.

    Rows are told by id and text. Of several texts of that id in one group the one
    with the least hash stays, of equal rows one; an id may stay in several groups,
    with a text in each. Only rows that may have to go, told by a bitmap, are
    shuffled, to be joined to the keys of those that do; all others stay where they are.
    """
    fps, named = grouped(docs)
    keys = fps.groupBy("id", "th", "fp").agg(F.count("*").alias("n")).join(named, "fp")
    stays = (F.col("id") == F.col("component")) & (F.col("th") == F.col("kept"))
    moved = cut(keys.where(~stays | (F.col("n") > 1)).select(F.xxhash64("id", "th").alias("__key"), stays.alias("__several")))
    rows = docs.withColumns(dict(zip(("__id", "__th"), row_key(), strict=True))).withColumn("__key", F.xxhash64("__id", "__th")).drop("__id", "__th")
    maybe, rest = split_by_keys(rows, moved.select("__key"), "__key")
    out = rest.unionByName(maybe.join(moved.select("__key"), "__key", "left_anti"))
    several = moved.where("__several").select("__key")
    if several.limit(1).count():
        out = out.unionByName(one_of_each(split_by_keys(rows, several, "__key")[0].join(several, "__key", "left_semi"), docs.columns))
    return out.drop("__key")


def one_of_each(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per ``__key``: the one with the least hash. Tasks reduce equal rows before any shuffle."""
    tagged = rows.distinct().withColumn("__row", F.xxhash64(*columns))
    return tagged.groupBy("__key").agg(F.min_by(F.struct(*columns), "__row").alias("__one")).select("__key", "__one.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(real("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real("component").alias("component_id"))
