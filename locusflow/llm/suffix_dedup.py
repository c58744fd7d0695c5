"""Removal of repeated strings of LENGTH bytes by a prefix-free parse of the corpus.

Rolling hashes of GRAM bytes trigger phrase breaks: a string's trigger is the
least hash among its first WINDOW positions. A phrase is the run of strings that
share a trigger, with all bytes that they cover, so phrases overlap by LENGTH - 1
bytes and no string crosses one. Equal strings have equal triggers and equal bytes
after them, so all that may be equal lies under one context. The dictionary holds
each distinct phrase once, parted by context, and the parse says how often and where
a phrase stands. A suffix array is made of each part of the dictionary, by prefix
doubling to the depth of LENGTH bytes; its places, each as often as the parse has
their phrase, are the corpus's order of strings, and equal neighbours are repeats. As
phrases overlap by more than the parse's order could add, strings of LENGTH bytes
need none beyond it: a phrase that is parsed twice is repeated whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.common import cut, documents, may_hold, mix

LENGTH, WINDOW, GRAM = 400, 256, 16
CONTEXT = LENGTH - WINDOW
#: Longer texts are parsed in pieces of so many string starts.
PIECE = 1 << 19
#: Contexts with more distinct phrases are compared string by string over all tasks.
CROWD = 2048
#: Bits for how many starts follow a phrase's first.
MORE = 9
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_tables: dict = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64."""
    if base not in _tables or len(_tables[base][0]) <= n:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        _tables[base] = tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(n, PIECE + LENGTH + 1), x, np.uint64)))) for x in (base, inverse))
    return tuple(x[: n + 1] for x in _tables[base])


class Hashes:
    """Hashes of any substrings of a piece, by prefix sums; equal strings hash alike wherever they stand."""

    def __init__(self, raw: np.ndarray, base: np.uint64):
        up, self.down = powers(base, len(raw))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def pieces(raw: np.ndarray):
    """(offset, bytes) of a text so that each string of LENGTH bytes starts in just one."""
    starts = len(raw) - LENGTH + 1
    for at in range(0, max(0, starts), PIECE):
        yield at, raw[at : at + PIECE + LENGTH - 1]


def parse(raw: np.ndarray):
    """Phrases of a piece: first and last string start, trigger, context hash, phrase hash."""
    n = len(raw) - LENGTH + 1
    g = raw.astype(np.uint64) + np.uint64(1)
    base, width = _BASES[0], 1
    with np.errstate(over="ignore"):
        while width < GRAM:
            g = g[:-width] * base + g[width:]
            base, width = base * base, 2 * width
    low = np.uint64((1 << 24) - 1)
    x = (mix(g[: n + WINDOW - 1]) & ~low) | np.arange(n + WINDOW - 1, dtype=np.uint64)
    width = 1
    while width < WINDOW:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    trigger = (x & low).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(trigger)) + 1))
    last, at = np.append(first[1:] - 1, n - 1), trigger[first]
    a, b = (Hashes(raw, x) for x in _BASES)
    shape = ((at - first) << 9 | (last - first)).astype(np.uint64)
    return first, last, a.of(at, at + CONTEXT), mix(b.of(first, last + LENGTH) ^ mix(shape + np.uint64(1)))


def phrases(docs: DataFrame) -> DataFrame:
    """(id, starts, ctx, phrase): the parse of all texts (id, text); ``starts`` packs the first start and how many follow."""

    def run(batches):
        for batch in batches:
            got = []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                raw = np.frombuffer((t.as_py() or "").encode("utf-8", "replace"), np.uint8)
                for at, piece in pieces(raw):
                    first, last, ctx, phrase = parse(piece)
                    got.append((np.full(len(first), i), (first + at) << MORE | (last - first), ctx.view(np.int64), phrase.view(np.int64)))
            cols = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "starts", "ctx", "phrase"])

    return docs.mapInArrow(run, "id long, starts long, ctx long, phrase long")


def string_hashes(raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``n`` string starts, and two hashes of each string."""
    s = np.arange(n)
    return s, *(Hashes(raw, x).of(s, s + LENGTH) for x in _BASES)


def suffix_ranks(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks of the LENGTH bytes from each start, in the order of bytes: equal strings have one rank.

    The suffix array by prefix doubling: ranks of 8 bytes, then of twice as many by
    pairs of ranks, and at last of LENGTH by a pair that overlaps.
    """
    padded = np.concatenate((raw, np.zeros(LENGTH, np.uint8)))
    rank = np.unique(np.ndarray((len(raw),), ">u8", buffer=padded, strides=(1,)).astype(np.uint64), return_inverse=True)[1]
    depth = 8
    while 2 * depth <= LENGTH:
        after = np.concatenate((rank[depth:], np.zeros(min(depth, len(rank)), rank.dtype)))
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1]
        depth *= 2
    return np.unique(rank[starts] * (len(rank) + 1) + rank[starts + LENGTH - depth], return_inverse=True)[1]


def phrase_bytes(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(ctx, id, lo, more, one, bytes) of the phrases at ``places`` (ctx, id, starts, one)."""
    wanted = places.groupBy("id").agg(F.collect_list(F.struct("ctx", "starts", "one")).alias("r"))

    def run(batches):
        for batch in batches:
            got = []
            for i, t, r in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("r").to_pylist(), strict=True):
                raw = t.as_py().encode("utf-8", "replace")
                for x in r:
                    lo, more = x["starts"] >> MORE, x["starts"] & (1 << MORE) - 1
                    got.append((x["ctx"], i, lo, more, x["one"], raw[lo : lo + more + LENGTH]))
            cols = list(zip(*got, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["ctx", "id", "lo", "more", "one", "bytes"])

    return may_hold(docs, places).join(wanted, "id").select("id", "text", "r").mapInArrow(run, "ctx long, id long, lo int, more int, one boolean, bytes binary")


def repeats_among(rows: list) -> list[tuple[int, int, int]]:
    """(id, lo, hi) of strings of phrases (id, lo, more, one, bytes) that another phrase has too, if ``one``.

    ``rows`` are parts of the dictionary; their suffix array is made here.
    """
    size = np.array([len(r[4]) for r in rows])
    n = np.array([r[2] + 1 for r in rows])
    own = np.repeat(np.arange(len(rows)), n)
    s = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    rank = suffix_ranks(np.frombuffer(b"".join(r[4] for r in rows), np.uint8), s + np.repeat(np.cumsum(size) - size, n))
    one = np.array([r[3] for r in rows], bool)
    at = np.flatnonzero((np.bincount(rank)[rank] > 1) & one[own])  # neighbours in the array with one rank
    breaks = np.flatnonzero((np.diff(own[at]) != 0) | (np.diff(s[at]) != 1)) + 1
    first, last = np.concatenate(([0], breaks)) if len(at) else breaks, np.append(breaks, len(at)) - 1 if len(at) else breaks
    return [(rows[k][0], rows[k][1] + x, rows[k][1] + y) for k, x, y in zip(own[at[first]].tolist(), s[at[first]].tolist(), s[at[last]].tolist(), strict=True)]


def ranges_batch(rows: list[tuple[int, int, int]], names=("lo", "hi")) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", *names])


def repeats_by_context(rows: DataFrame) -> DataFrame:
    """Repeated strings of contexts with few phrases, each context in one task, a few contexts at a time."""

    def run(batches):
        held: list = []
        for b in batches:
            for ctx, *row in zip(*(b.column(c).to_pylist() for c in ("ctx", "id", "lo", "more", "one", "bytes")), strict=True):
                if len(held) >= CROWD and held[-1][0] != ctx:
                    yield ranges_batch(repeats_among([r for _, r in held]))
                    held = []
                held.append((ctx, row))
        if held:
            yield ranges_batch(repeats_among([r for _, r in held]))

    return rows.repartition("ctx").sortWithinPartitions("ctx").mapInArrow(run, "id long, lo int, hi int")


def repeats_by_string(rows: DataFrame) -> DataFrame:
    """Repeated strings of contexts with very many phrases: all strings are dealt out by hash.

    Those that stand once are taken off by their places, which no two share, so a
    string that very many phrases have loads no task.
    """

    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                got = []
                for i, lo, more, one, raw in zip(*(b.column(c).to_pylist() for c in ("id", "lo", "more", "one", "bytes")), strict=True):
                    s, h1, h2 = string_hashes(np.frombuffer(raw, np.uint8), more + 1)
                    got.append((h1.view(np.int64), h2.view(np.int64), np.full(len(s), i), (s + lo).astype(np.int32), np.full(len(s), one)))
                cols = [np.concatenate(c) for c in zip(*got, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h1", "h2", "id", "lo", "one"])

    strings = rows.mapInArrow(run, "h1 long, h2 long, id long, lo int, one boolean")
    strings = cut(strings)
    single = strings.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("lo").alias("lo")).where("n = 1").select("id", "lo")
    return strings.where("one").select("id", "lo").join(single, ["id", "lo"], "left_anti").select("id", "lo", F.col("lo").alias("hi"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(id, lo, hi): ranges of starts of repeated strings in texts (id, text)."""
    parsed = cut(phrases(docs))
    ctx = parsed.groupBy("ctx").agg(F.count("*").alias("n"), F.min("phrase").alias("a"), F.max("phrase").alias("b"))
    ctx = cut(ctx.where("n > 1").select("ctx", (F.col("a") != F.col("b")).alias("varied")))
    shared = cut(parsed.join(ctx, "ctx"))
    # The dictionary of the phrases under contexts that have several, each with one place of its own.
    varied = shared.where("varied")
    dictionary = cut(varied.groupBy("ctx", "phrase").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("starts").alias("starts"), F.min(F.struct("id", "starts")).alias("at")))
    # Phrases that are parsed once are taken off by their places; the others may be very common, so no join goes by phrase.
    once = dictionary.where("n = 1").select("id", "starts")
    again = varied.select("id", "starts").join(once, ["id", "starts"], "left_anti")
    whole = shared.where("not varied").select("id", "starts").unionByName(again)
    first = F.shiftright("starts", MORE)
    whole = whole.select("id", first.cast("int").alias("lo"), (first + F.col("starts").bitwiseAND(F.lit((1 << MORE) - 1))).cast("int").alias("hi"))
    crowds = cut(dictionary.groupBy("ctx").agg(F.count("*").alias("phrases")).where(F.col("phrases") > CROWD).select("ctx", F.lit(True).alias("crowd")))
    places = dictionary.join(crowds, "ctx", "left").select("ctx", "at.*", (F.col("n") == 1).alias("one"), "crowd")
    out = whole.unionByName(repeats_by_context(phrase_bytes(docs, cut(places.where("crowd is null").drop("crowd")))))
    if crowds.limit(1).count():
        out = out.unionByName(repeats_by_string(cut(phrase_bytes(docs, cut(places.where("crowd").drop("crowd"))))))
    return out


def covered_runs(ranges: DataFrame) -> DataFrame:
    """(id, a, b): the maximal runs of bytes that strings starting in ``ranges`` (id, lo, hi) cover.

    Each run has LENGTH bytes at least, so a text has few. Equal ranges, such as
    those of repeated rows, are reduced before the shuffle by id.
    """

    def run(batches):
        held: tuple | None = None
        for batch in batches:
            out = []
            for i, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("id", "lo", "hi")), strict=True):
                if held and held[0] == i and lo <= held[2]:
                    held = (i, held[1], max(held[2], hi + LENGTH))
                else:
                    out += [held] if held else []
                    held = (i, lo, hi + LENGTH)
            yield ranges_batch(out, "ab")
        if held:
            yield ranges_batch([held], "ab")

    distinct = ranges.groupBy("id", "lo").agg(F.max("hi").alias("hi"))
    return distinct.repartition("id").sortWithinPartitions("id", "lo").mapInArrow(run, "id long, a int, b int")


def told_apart(docs: DataFrame) -> DataFrame:
    """(id, doc_id, text): rows of one ``doc_id`` have ids by their texts; null texts are empty."""
    return docs.select(F.xxhash64("doc_id", "text").alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def dedup_rows(rows: DataFrame) -> DataFrame:
    """``dedup_strings`` of rows (id, doc_id, text), with the id."""
    found = cut(covered_runs(repeated_ranges(rows.select("id", "text"))))
    ranges = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("r"))

    def run(batches):
        for batch in batches:
            out = []
            for t, r in zip(batch.column("text"), batch.column("r").to_pylist(), strict=True):
                raw = t.as_py().encode("utf-8", "replace")
                spans = [(x["a"], x["b"]) for x in r]
                ends = [0, *(b for _, b in spans)]
                kept = b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(raw)], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(spans), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = f"id long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    hit = may_hold(rows, found.select("id")).join(ranges, "id").select("id", "doc_id", "text", "r").mapInArrow(run, schema)
    n = F.octet_length("text").cast("bigint").alias("n_bytes")
    zero = F.lit(0).cast("bigint")
    rest = rows.select("id", "doc_id", n, F.sha2("text", 256).alias("kept_sha256")).join(ranges.select("id"), "id", "left_anti")
    hit = hit.select("id", "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return hit.unionByName(rest.select("id", "doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256"))


def dedup_strings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each text without the bytes of repeated strings.

    A cut may fall inside a character. Null texts are empty,
    repeated rows are repeats of each other, rows of one id are told apart by
    their texts, further columns are ignored, an empty table gives no rows.
    """
    return dedup_rows(told_apart(docs)).drop("id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_strings(documents(spark, sf_dir))
