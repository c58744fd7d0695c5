"""Runs of repeated words, found by bit-parallel lags.

Words become numbers, and bit b of all numbers one big integer, a plane. For a lag q
the planes are XORed with themselves shifted by q and the results ORed: a zero says
that the words q apart are the same. ANDing the agreements with themselves, shifted by
1, 2, 4, ... places, leaves a bit only where enough zeros stand in a row.

A lag is tried only if it may hold a run. A run of at least three periods q has three
places that q divides, and from the first of them on over q words agree with those q
later, so two neighbouring places have equal windows of words; all lags are asked at
once, with n * ln(n) comparisons of window hashes. Lags below WINDOW are all tried. A
hash that errs costs one lag more to try and loses nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.llm.common import documents, mix, odd_constants, texts

#: Words of the windows by which lags are chosen; a power of two.
WINDOW = 16
#: Fixed values of the query: words and periods that a run has at least.
MIN_WORDS, MIN_TIMES = 24, 3

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, in order of their first occurrence."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def bit_planes(ids: np.ndarray) -> list[int]:
    """Bit b of all numbers as one integer, whose bit i is that of word i."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(max(1, top))]


def window_hashes(ids: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW words from each place on; equal windows have equal hashes."""
    h, width = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    for c in odd_constants(WINDOW.bit_length() - 1, 13):
        h = mix(h[:-width] * c + h[width:]) if len(h) > width else h[:0]
        width *= 2
    return h


def likely_lags(ids: np.ndarray, most: int) -> np.ndarray:
    """Lags up to ``most`` that may hold a run: small ones, and those with two equal windows at neighbouring multiples."""
    g = window_hashes(ids)
    found = np.zeros(most + 1, bool)
    found[1:WINDOW] = True
    middle = max(WINDOW, int(len(ids) ** 0.5))
    for q in range(WINDOW, min(middle, most + 1)):  # short lags: all their places at once
        at = g[::q]
        found[q] = (at[1:] == at[:-1]).any()
    j = 0
    while middle <= most:  # long lags have few places: place j of all lags at once
        q = np.arange(middle, min(most, (len(g) - 1) // (j + 1)) + 1)
        if not len(q):
            break
        found[q] |= g[j * q] == g[(j + 1) * q]
        j += 1
    return np.flatnonzero(found)


def long_stretches(agree: int, need: int) -> int:
    """Bits from which ``need`` ones stand in a row, by doubling."""
    have = 1
    while agree and 2 * have <= need:
        agree &= agree >> have
        have *= 2
    return agree & (agree >> (need - have)) if agree and have < need else agree


def ones(x: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))


def stretches(planes: list[int], n: int, q: int, need: int) -> list[tuple[int, int]]:
    """(start, length) of maximal stretches whose words q apart agree, ``need`` times in a row at least."""
    whole, differ = (1 << (n - q)) - 1, 0
    for i, p in enumerate(planes):
        differ |= p ^ (p >> q)
        # What a few planes rule out no further plane brings back.
        if i == 3 and not long_stretches(~differ & whole, min(need, WINDOW)):
            return []
    left = long_stretches(~differ & whole, need)
    if not left:
        return []
    first, last = ones(left & ~(left << 1), n), ones(left & ~(left >> 1), n)
    return [(a, b - a + need + q) for a, b in zip(first.tolist(), last.tolist(), strict=True)]


def find_runs(words: list[bytes], min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start, then period.

    A run is a stretch with smallest period q of ``min_words`` words and ``min_times``
    periods at least (three or more), which no neighbouring word extends. Of a stretch
    that several lags give, the least lag is the smallest period. Multiples of a known
    run's period, and only these, are passed over inside it: there they give the same
    stretch again.
    """
    if min_times < 3:
        raise ValueError("min_times must be 3 at least")
    n = len(words)
    if n < max(min_words, min_times):
        return []
    ids = numbered(words)
    planes, runs = bit_planes(ids), {}
    run_of, periods = np.full(n, -1), []
    g = window_hashes(ids)
    for q in likely_lags(ids, n // min_times).tolist():
        if q >= WINDOW:
            at = np.arange(0, len(g) - q, q)
            at = at[g[at] == g[at + q]]
            inside = run_of[at]
            known = (inside >= 0) & (inside == run_of[at + q])
            if known.all() and not (q % np.array(periods)[inside]).any():
                continue
        for start, length in stretches(planes, n, q, max(min_words - q, (min_times - 1) * q, 1)):
            if (start, length) not in runs:
                runs[start, length] = q
                run_of[start : start + length] = len(periods)
                periods.append(q)
    return sorted(((s, m, q) for (s, m), q in runs.items()), key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone)
    return [w for w, g in zip(words, gone.tolist(), strict=False) if not g]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, compared exactly; of several the first, then of the shortest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapse_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed) of ``docs`` (doc_id, text): texts with each run cut to its first period.

    Rows are independent of each other: nothing is shuffled, and a task holds one text and
    its planes at a time, so a text may be as long as a string can. A null or empty text
    has no words, no runs and an empty ``collapsed``; ids may be null or repeat; an
    empty table gives an empty one; further columns are left out.
    """
    out = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS),
        T.StructField("strongest", RUNS.elementType), T.StructField("collapsed", T.StringType()),
    ])
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    as_row = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], []]
            for text in texts(batch):
                words = (text or "").encode("utf-8", "replace").split()
                runs = find_runs(words, min_words, min_times)
                for column, x in zip(rows, (len(words), [as_row(r) for r in runs], as_row(strongest(runs)), b" ".join(kept_words(words, runs)).decode()), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.list_(run), run, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], names=out.names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, out)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the contract's repetition: in a tenth of all documents, by the id's hash, the tail repeats."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def with_planted(docs: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            found = [b" ".join(planted((t or "").encode("utf-8", "replace").split(), i)).decode() for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, "doc_id bigint, text string")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document with the contract's repetitions: their number, the strongest, digests of all and of what is kept."""
    found = collapse_runs(with_planted(documents(spark, sf_dir)))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    s = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), s["start"].alias("start"), s["length"].alias("length"), s["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
