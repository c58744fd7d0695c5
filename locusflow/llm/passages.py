"""Documents that share a passage of over 50 words with another document.

A passage is PASSAGE words in a row, whatever blanks stand between them. The words
are parsed as ``suffix_dedup`` parses bytes: a passage's trigger is the least hash of
CONTEXT words among its first WINDOW words, a phrase is the run of passages that share
a trigger. Equal passages have equal triggers, so a phrase that two documents have
shares a passage at once, and others are compared passage by passage under the
contexts that several documents have. Documents are told from each other by counts of
what is theirs alone, so nothing that very many have loads one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.common import cut, documents, may_hold, mix, split_by_keys
from locusflow.llm.suffix_dedup import _BASES, Hashes, dedup_rows, told_apart

PASSAGE, WINDOW = 51, 44
CONTEXT = PASSAGE - WINDOW + 1
#: Bytes that are hashed at a time: short texts together, longer ones in pieces.
BLOCK = 1 << 18
#: Bits for how many bytes a phrase has.
SIZE = 32
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    edge = np.flatnonzero(np.diff(_BLANK[raw], prepend=True, append=True))
    return edge[::2], edge[1::2]


class Words:
    """Words of some bytes, with hashes of any run of them as if one blank stood between two."""

    def __init__(self, raw: np.ndarray):
        self.start, self.end = bounds(raw)
        size = self.end - self.start + 1
        self._end = np.cumsum(size) - 1
        self._start = self._end - (size - 1)
        keep = ~_BLANK[raw]
        keep[self.end[self.end < len(raw)]] = True
        self._raw = raw[keep]
        self._raw[self._end[self._end < len(self._raw)]] = 32

    def hashes(self, base: np.uint64):
        """A function from first and last words to hashes."""
        found = Hashes(self._raw, base)
        return lambda first, last: found.of(self._start[first], self._end[last])


def pieces(raw: np.ndarray):
    """(offset, bytes) of a text so that each passage lies whole in just one."""
    at, size = 0, BLOCK
    while at + size < len(raw):
        end = at + size
        while end < len(raw) and not (blank := _BLANK[raw[end : end + BLOCK]]).any():
            end += len(blank)
        end += int(_BLANK[raw[end : end + BLOCK]].argmax()) if end < len(raw) else 0
        start = bounds(raw[at:end])[0]
        if len(start) < PASSAGE and end < len(raw):
            size *= 2
            continue
        yield at, raw[at:end]
        if end >= len(raw):
            return
        at, size = at + int(start[1 - PASSAGE]), BLOCK
    yield at, raw[at:]


def blocks(batch: pa.RecordBatch):
    """Pieces (id, offset, bytes) of about BLOCK bytes together."""
    held, n = [], 0
    for i, t in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
        for at, piece in pieces(np.frombuffer(t.as_buffer(), np.uint8)):
            held.append((i, at, piece))
            n += len(piece)
            if n >= BLOCK:
                yield held
                held, n = [], 0
    if held:
        yield held


def joined(texts: list[np.ndarray]) -> tuple[Words, np.ndarray]:
    """The words of several texts, and which text each is of."""
    w = Words(np.frombuffer(b" ".join(texts), np.uint8))
    return w, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), w.start, side="right")


def parse(texts: list[np.ndarray]):
    """Phrases of texts: which text, byte offset and size there, context hash, phrase hash."""
    w, own = joined(texts)
    n = len(own) - PASSAGE + 1
    if n <= 0:
        return [np.zeros(0, np.int64)] * 5
    a, b = (w.hashes(x) for x in _BASES)
    i = np.arange(n + WINDOW - 1)
    context = a(i, i + CONTEXT - 1)
    low = np.uint64((1 << 24) - 1)
    x = (context & ~low) | i.astype(np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    x = np.minimum(x[: width - WINDOW or None], x[WINDOW - width :])
    trigger = np.where(own[:n] == own[PASSAGE - 1 :], (x & low).astype(np.int64), -1)
    first = np.concatenate(([0], np.flatnonzero(np.diff(trigger)) + 1))
    last = np.append(first[1:] - 1, n - 1)
    inside = trigger[first] >= 0
    first, last = first[inside], last[inside]
    at, text = trigger[first], own[first]
    shape = ((at - first) << 8 | (last - first)).astype(np.uint64)
    begin = w.start[first]
    before = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return [text, begin - before[text], w.end[last + PASSAGE - 1] - begin, context[at].view(np.int64), mix(b(first, last + PASSAGE - 1) ^ mix(shape + np.uint64(1))).view(np.int64)]


def phrases(docs: DataFrame) -> DataFrame:
    """(id, place, ctx, phrase): the parse of all texts (id, text); ``place`` packs byte offset and size."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch):
                text, at, size, ctx, phrase = parse([piece for _, _, piece in block])
                ids, offsets = (np.array([x[k] for x in block], np.int64)[text] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, (at + offsets) << SIZE | size, ctx, phrase)], names=["id", "place", "ctx", "phrase"])

    return docs.mapInArrow(run, "id long, place long, ctx long, phrase long")


def hashed(ids: list[int], texts: list[np.ndarray]) -> pa.RecordBatch:
    """Id and two hashes of each passage of the texts."""
    w, own = joined(texts)
    k = np.flatnonzero(own[: 1 - PASSAGE] == own[PASSAGE - 1 :])
    h1, h2 = (w.hashes(x)(k, k + PASSAGE - 1).view(np.int64) for x in _BASES)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.array(ids, np.int64)[own[k]], h1, h2)], names=["id", "h1", "h2"])


def passages(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(id, h1, h2): two hashes of each passage of the phrases at ``places`` (id, place)."""
    wanted = places.groupBy("id").agg(F.collect_list("place").alias("r"))

    def run(batches):
        for batch in batches:
            held, ids = [], []
            for i, t, r in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("r").to_pylist(), strict=True):
                raw = np.frombuffer(t.as_buffer(), np.uint8)
                for place in r:
                    held.append(raw[(at := place >> SIZE) : at + (place & (1 << SIZE) - 1)])
                    ids.append(i)
                    if len(held) == 512:
                        yield hashed(ids, held)
                        held, ids = [], []
            if held:
                yield hashed(ids, held)

    return may_hold(docs, places).join(wanted, "id").select("id", "text", "r").mapInArrow(run, "id long, h1 long, h2 long")


def sharers(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Ids that have more ``rows`` (id, ...) than lie in ``groups`` (n, a, b) of one id alone."""
    alone = groups.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("alone"))
    return rows.groupBy("id").agg(F.count("*").alias("n")).join(alone, "id", "left").where("n > coalesce(alone, 0)").select("id")


def shared_passages(docs: DataFrame) -> DataFrame:
    """The ids of the texts (id, text) that share a passage with a text of another id."""
    n, a, b = F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")
    parsed = cut(phrases(docs.where(F.octet_length("text") >= 2 * PASSAGE - 1)))
    common = cut(parsed.groupBy("ctx").agg(a, b).where("a != b").select("ctx"))
    held = split_by_keys(parsed, common, "ctx")[0]
    dictionary = cut(held.groupBy("ctx", "phrase").agg(n, a, b, F.min(F.struct("id", "place")).alias("at")))
    found = cut(sharers(held, dictionary))
    # Phrases of the other documents, and all that may share a passage with these.
    unsure = dictionary.where("a = b").select("ctx", F.col("a").alias("id")).join(found, "id", "left_anti").select("ctx").distinct()
    unsure = cut(unsure.join(common, "ctx", "left_semi"))
    places = cut(dictionary.join(unsure, "ctx", "left_semi").select("at.*"))
    each = cut(passages(docs, places))
    return found.unionByName(sharers(each, each.groupBy("h1", "h2").agg(n, a, b))).distinct()


def dedup_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage): what ``dedup_strings`` says of each text,
    and 1 if it shares a passage of over 50 words with another text or id, however many bytes that has, else 0.

    Rows equal in id and text are one document here.
    """
    rows = told_apart(docs)
    shared = cut(shared_passages(rows.select("id", "text"))).withColumn("shares_passage", F.lit(1))
    return dedup_rows(rows).join(shared, "id", "left").drop("id").fillna(0, ["shares_passage"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(documents(spark, sf_dir))
