"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by size; for a class of items of q to 2q-1 shingles a
document is cut into blocks of q shingles, and three neighbouring blocks form a
window, so an item lies whole in some window of comparable size. An item that a
window contains shares the least hash under each of K permutations with
probability of at least a quarter, so one of K agrees but for one time in ten
thousand. An item that repeats itself has fewer distinct shingles than q, so that
bound fails; all but a few of its shingles must be in a document, hence one of those
few and one more, and these are looked up themselves, without any chance of a miss. Documents with such an item are then verified by their exact shingles.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.common import WORD, cut, documents, mix, odd_constants, row_id, texts, words_of

SHINGLE, THRESHOLD, K = 5, 0.8, 32
#: UTF-8 bytes of items that are broadcast at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 4 << 20
PERMUTATIONS = odd_constants(K, 2)
SALT = mix(np.arange(K, dtype=np.uint64) + np.uint64(77))
COEFFS = odd_constants(SHINGLE, 3)
STEP = 4096


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    w = mix(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))
    m = len(w) - n + 1
    h = np.zeros(max(0, m), np.uint64)
    for i in range(n if m > 0 else 0):
        h += w[i : i + m] * COEFFS[i]
    return mix(h)


def signatures(h: np.ndarray, block: int) -> np.ndarray:
    """Least hash of each block of ``block`` shingles under each permutation: K rows."""
    step, out = max(block, STEP // block * block), []
    for at in range(0, len(h), step):
        part = h[at : at + step]
        out.append(np.minimum.reduceat(part[None, :] * PERMUTATIONS[:, None], np.arange(0, len(part), block), axis=1))
    return np.concatenate(out, axis=1)


def shingle_set(words: list[bytes], n: int) -> set:
    return set(zip(*(words[i:] for i in range(n)), strict=False))


@dataclass
class Index:
    """A block of items: by shingle length, by size class, the least hashes and whose they are."""

    ids: list
    sets: list[set]
    lengths: list[int]
    classes: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]
    #: By shingle length, hashes of repetitive items and whose they are.
    exact: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[tuple], threshold: float = THRESHOLD) -> Index:
        """Items (id, text): fewer than five words make one shingle of their own length; no words, none."""
        ids, sets, lengths, found, repetitive = [], [], [], {}, {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            n = min(SHINGLE, len(words))
            sets.append(shingle_set(words, n))
            ids.append(item_id)
            lengths.append(n)
            h = np.unique(shingle_hashes(words, n))
            size = 1 << (len(words) - n + 1).bit_length() - 1
            if len(h) < size:
                m = len(sets[-1])
                needed = next(k for k in range(int(threshold * m), m + 2) if k / m >= threshold or k > m)
                some = h[: max(1, m - max(1, needed) + 1)]
                repetitive.setdefault(n, []).append((some, np.full(len(some), len(ids) - 1)))
                continue
            found.setdefault(n, {}).setdefault(size, []).append((len(ids) - 1, signatures(h, max(1, len(h)))[:, 0] + SALT))
        classes, exact = {}, {}
        for n, rows in repetitive.items():
            keys, own = map(np.concatenate, zip(*rows, strict=True))
            order = np.argsort(keys, kind="stable")
            exact[n] = keys[order], own[order]
        for n, by in found.items():
            for size, rows in by.items():
                keys, own = np.concatenate([s for _, s in rows]), np.repeat([i for i, _ in rows], K)
                order = np.argsort(keys, kind="stable")
                classes.setdefault(n, {})[size] = (keys[order], own[order])
        return cls(ids, sets, lengths, classes, exact)

    def candidates(self, words: list[bytes]) -> set[int]:
        """Items that share a least hash with a window of the document, and repetitive ones that share a hash they cannot do without."""
        out: set[int] = set()

        def look_up(keys, own, seen):
            lo, hi = np.searchsorted(keys, seen), np.searchsorted(keys, seen, side="right")
            for i in np.flatnonzero(lo < hi):
                out.update(own[lo[i] : hi[i]].tolist())

        for n in sorted(self.classes.keys() | self.exact.keys()):
            h, by = shingle_hashes(words, n), self.classes.get(n)
            if not len(h):
                continue
            if n in self.exact:
                look_up(*self.exact[n], np.unique(h))
            if not by:
                continue
            sizes = sorted(by)
            base = signatures(h, sizes[0])
            for size in sizes:
                if size > sizes[0]:
                    base = np.minimum.reduceat(base, np.arange(0, base.shape[1], size // prev), axis=1)
                prev = size
                window = base
                if base.shape[1] > 1:
                    window = np.minimum(base[:, :-1], base[:, 1:])
                    if window.shape[1] > 1:
                        window = np.minimum(window[:, :-1], base[:, 2:])
                look_up(*by[size], np.unique(window + SALT[:, None]))
        return out

    def matches(self, words: list[bytes], threshold: float):
        """(item index, containment) of the items that the document truly contains."""
        own: dict[int, set] = {}
        for i in sorted(self.candidates(words)):
            n = self.lengths[i]
            if n not in own:
                own[n] = shingle_set(words, n)
            part = len(self.sets[i] & own[n]) / len(self.sets[i])
            if part >= threshold:
                yield i, part


def item_blocks(items: DataFrame, limit: int):
    """Lists of (item_id, text) of at most ``limit`` bytes each, or of one item."""
    block, used = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull()).toLocalIterator():
        n = len(r.text.encode("utf-8", "replace"))
        if block and used + n > limit:
            yield block
            block, used = [], 0
        block.append((r.item_id, r.text))
        used += n
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, threshold: float, block_bytes: int, schema, judge, chained: bool) -> list[DataFrame]:
    """``judge(index, batch)`` over all rows, block by block of the benchmark.

    One block's index is broadcast and held at a time: where there are several, what
    each gives is written before the next is made. ``chained`` blocks go on from what the one
    before left, others each look at all rows.
    """
    spark, out, blocks = docs.sparkSession, [], item_blocks(items, block_bytes)
    block = next(blocks, None)
    while block is not None:
        index, after = spark.sparkContext.broadcast(Index.of(block, threshold)), next(blocks, None)  # at most block_bytes of text, or one item

        def run(batches, index=index):
            for b in batches:
                yield judge(index.value, b)

        found = docs.mapInArrow(run, schema)
        if after is not None or out:
            found = cut(found)
            index.destroy()
        if chained:
            docs, out = found, [found]
        else:
            out.append(found)
        block = after
    return out


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, containment, n_shingles) of each document and item that it contains.

    Containment is the share of the item's distinct word shingles that the whole
    document has. Null and empty texts contain nothing and are contained nowhere,
    repeated rows match alike, rows without doc_id are told by their text, an
    empty table on either side gives no rows. Item ids may be of any type that goes to text and back.
    """
    source = docs.select(row_id(F.col("doc_id"), F.col("text")).alias("id"), "text")
    schema = "id long, item_id string, containment double, n_shingles int"

    def judge(ix: Index, b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(r, i, p) for r, t in enumerate(texts(b)) for i, p in ix.matches(words_of(t), threshold)]
        return pa.RecordBatch.from_arrays(
            [b.column("id").take(pa.array([r for r, _, _ in rows], pa.int64())), pa.array([ix.ids[i] for _, i, _ in rows], pa.string()),
             pa.array([p for _, _, p in rows], pa.float64()), pa.array([len(ix.sets[i]) for _, i, _ in rows], pa.int32())],
            names=["id", "item_id", "containment", "n_shingles"],
        )

    found = search(source, items, threshold, block_bytes, schema, judge, chained=False)
    out = reduce(DataFrame.unionByName, found, docs.sparkSession.createDataFrame([], schema))
    return out.withColumn("item_id", F.col("item_id").cast(items.schema["item_id"].dataType))


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows whose text contains an item, as ``find_leaks`` finds them.

    Each row is judged where it lies, so no text is shuffled. Null and empty texts
    stay, of several rows of one id only those go that contain an item, repeated
    rows go or stay alike, an empty table on either side drops nothing.
    """

    def judge(ix: Index, b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array([next(ix.matches(words_of(t), threshold), None) is None for t in texts(b)], pa.bool_()))

    return (search(docs, items, threshold, block_bytes, docs.schema, judge, chained=True) or [docs])[-1]


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it contains."""
    found = find_leaks(documents(spark, sf_dir), benchmark(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "item_id", F.round("containment", 6).alias("containment"), F.col("n_shingles").cast("bigint").alias("n_shingles"))


_WORDS = f"regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
#: Exact containment by joining all distinct shingles.
SQL = f"""WITH b0 AS (SELECT item_id, {_WORDS} AS w FROM benchmark), b1 AS (SELECT item_id, w, least({SHINGLE}, len(w)) AS n FROM b0 WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS s FROM b1),
size AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY 1), lens AS (SELECT DISTINCT n FROM b),
d0 AS (SELECT doc_id, {_WORDS} AS w FROM documents),
d AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS s FROM d0, lens WHERE len(w) >= n)
SELECT doc_id, item_id, round(count(*) / n_shingles, 6) AS containment, CAST(n_shingles AS BIGINT) AS n_shingles FROM d JOIN b USING (n, s) JOIN size USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) / n_shingles >= {THRESHOLD}"""
