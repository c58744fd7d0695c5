"""Order MinHash fingerprints: signatures that feel both edits and moved text.

k-mers of code points are numbered by occurrence, so the second of a kind differs
from the first. The hash of a numbered k-mer puts it into one of BINS bins; each
bin keeps its LEAST smallest, in the order in which they stand in the text, and
the hash of that tuple is one component of the signature.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.llm.common import cut, documents, mix, row_id, texts

K, BINS, LEAST = 8, 32, 2
#: Expected k-mers per bin that are looked at first; a bin that gets fewer than LEAST of them makes all be looked at.
FIRST = 16
#: Signature components have so many hex digits; an empty bin is all zeros.
DIGITS = 8
#: Bytes of text a part of the shuffle should hold.
PART_BYTES = 64 << 20
_B = np.uint64(0x9E3779B97F4A7C15)
_PACK = 22


def kmers(codes: np.ndarray) -> np.ndarray:
    """Hashes of all k-mers; a shorter text is one k-mer of its own."""
    h, base, n = codes.astype(np.uint64) + np.uint64(1), _B, len(codes)
    if n < K:
        out = np.uint64(n)
        with np.errstate(over="ignore"):
            for c in h:
                out = out * base + c
        return mix(np.array([out], np.uint64)) if n else np.zeros(0, np.uint64)
    width = 1
    with np.errstate(over="ignore"):
        while width < K:
            h = h[:-width] * base + h[width:]
            base, width = base * base, 2 * width
    return mix(h)


def occurrences(h: np.ndarray) -> np.ndarray:
    """How often the same k-mer stood before each place."""
    n = len(h)
    if n < 1 << _PACK:
        keep = np.uint64((1 << 64) - (1 << _PACK))
        packed = np.sort((h & keep) | np.arange(n, dtype=np.uint64))
        at = (packed & ~keep).astype(np.int64)
        key = packed & keep
    else:
        at = np.argsort(h, kind="stable")
        key = h[at]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    out = np.zeros(n, np.uint64)
    if len(new) < n:
        out[at] = (np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))).astype(np.uint64)
    return out


def order_minhash(codes: np.ndarray) -> np.ndarray:
    """BINS components of a text's signature, 0 for bins without k-mers."""
    h = kmers(codes)
    out = np.zeros(BINS, np.uint64)
    if not len(h):
        return out
    occ = occurrences(h)
    again = np.flatnonzero(occ)
    h[again] = mix(h[again] + occ[again] * _B)
    bins, rank = (h >> np.uint64(59)).astype(np.int64), h & np.uint64((1 << 59) - 1)
    at = np.arange(len(h))
    if len(h) > 4 * FIRST * BINS:
        near = np.flatnonzero(rank < np.uint64((1 << 59) * FIRST * BINS // len(h)))
        if np.bincount(bins[near], minlength=BINS).min() >= LEAST:
            at, bins, rank = near, bins[near], rank[near]
    order = np.lexsort((rank, bins))
    at, bins = at[order], bins[order]
    start = np.searchsorted(bins, np.arange(BINS))
    size = np.diff(np.append(start, len(bins)))
    for b in np.flatnonzero(size):
        value = np.uint64(b + 1)
        for i in np.sort(at[start[b] : start[b] + min(LEAST, size[b])]):
            value = value * _B + h[i]
        out[b] = value
    return np.where(out > 0, mix(out) >> np.uint64(32) | np.uint64(1), out)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components among bins that either text fills; two empty texts are alike."""
    some = (a != 0) | (b != 0)
    n = int(some.sum())
    return float(((a == b) & some).sum() / n) if n else 1.0


def as_text(sig: np.ndarray) -> str:
    return "".join(f"{int(x):0{DIGITS}x}" for x in sig)


def signature(text: str | None) -> np.ndarray:
    with np.errstate(over="ignore"):
        return order_minhash(np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each whole text, in place: no shuffle."""

    def run(batches):
        for b in batches:
            sig = [as_text(signature(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sig, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by as many first code points of ``after``, or all of them."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def neighbour_parts(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (doc_id, text) in ``parts`` ranges of descending id, sorted within each.

    Rows of one id follow one another by the hash of their texts, then by text, so an
    id that many rows share is cut as other ids are; where whole rows are equal
    it does not matter which of them comes first, so these are cut at random.
    """
    rows = docs.select(row_id(F.col("doc_id"), F.col("text")).alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("id").desc(), F.col("turn").asc()]
    placed = rows.withColumns({"turn": F.xxhash64("text"), "salt": F.rand(7)}).repartitionByRange(parts, *order, "salt")
    return placed.sortWithinPartitions(*order, "text").select("doc_id", "text")


#: Fingerprints are raw bytes until they are shown, which halves what is written.
REPORT = T.StructType().add("doc_id", "long").add("n_chars", "long").add("edited_sha256", "binary").add("fingerprint", "binary").add("edited_fingerprint", "binary").add("near_edited", "double").add("near_next", "double")


def report(doc_id: int | None, text: str, sig: np.ndarray, after: str, after_sig: np.ndarray) -> tuple:
    """A row of REPORT: a document beside its edited text and the next document."""
    new = edited(text, after)
    new_sig = signature(new)
    raw = lambda x: x.astype(">u4").tobytes()
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "replace")).digest(), raw(sig), raw(new_sig), likeness(sig, new_sig), likeness(sig, after_sig)


def reported(rows: list[tuple], fields: T.StructType) -> pa.RecordBatch:
    types = {"long": pa.int64(), "integer": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[f.dataType.typeName()]) for c, f in zip(cols, fields, strict=True)], names=fields.names)


def within_parts(placed: DataFrame) -> DataFrame:
    """REPORT of all rows but the last of each part, and two rows more a part: ``first``, its first text; ``last``, its last document."""
    fields = T.StructType([*REPORT, T.StructField("part", T.IntegerType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType())])
    none = (None,) * len(REPORT)

    def run(batches):
        part, held = TaskContext.get().partitionId(), None
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                sig = signature(text)
                out.append((*report(*held, text, sig), None, None, None) if held else (*none, part, text, None))
                held = doc_id, text, sig
            yield reported(out, fields)
        if held:
            yield reported([(held[0], *none[1:], part, None, held[1])], fields)

    return placed.mapInArrow(run, fields)


def across_parts(edges: DataFrame) -> DataFrame:
    """REPORT of each part's last document from its own and the next part's edge; of the last part's, from the first part's."""
    spark = edges.sparkSession
    parts = sorted(r.part for r in edges.where("first is not null").select("part").collect())  # a number a part
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next int")
    after = edges.where("first is not null").select(F.col("part").alias("next"), F.col("first").alias("after"))
    pairs = edges.where("last is not null").select("part", "doc_id", F.col("last").alias("text")).join(follows, "part").join(after, "next")

    def run(batches):
        for b in batches:
            rows = zip(b.column("doc_id").to_pylist(), texts(b), texts(b, "after"), strict=True)
            yield reported([report(i, t, signature(t), a, signature(a)) for i, t, a in rows], REPORT)

    return pairs.select("doc_id", "text", "after").mapInArrow(run, REPORT)


def edit_report(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document in descending id.

    Null texts are empty; rows without id come first, by a hash of their texts; repeated ids
    follow one another by hash of text and text, repeated rows in any order, as their
    reports are the same but for the last; a single document is its own successor; an empty
    table gives no rows, further columns are ignored. Texts are shuffled once, in ``parts`` parts
    (by default of PART_BYTES); a long text needs memory for its own k-mers only.
    """
    spark = docs.sparkSession
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    found = cut(within_parts(neighbour_parts(docs, parts)))
    rows = found.where("part is null").select(REPORT.names).unionByName(across_parts(found.where("part is not null")))
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(documents(spark, sf_dir))
