"""Importance resampling towards a target: n-grams of words in buckets, counted by suffix arrays.

A block of texts is one array of word numbers with a 0 after each text. Its suffixes are
sorted as far as n words deep; where neighbours share n words or more (their longest
common prefix), they are occurrences of one n-gram. Each such run is hashed once, and
its bucket is scattered back to all places where the n-gram stands. Blocks hold some
megabytes of text, so a task's memory does not grow with its partition.

A corpus is gone through twice, once for the counts by bucket and once for the scores:
both passes are independent by row, and only a row a document is ever shuffled.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.llm.common import cut, documents, texts

#: Fixed values of the query: longest n-gram, buckets, words that a drawn document has at least, per cent drawn, seed.
LONGEST, BUCKETS, LEAST_WORDS, PER_CENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of text in a block, unless one text is longer.
BLOCK = 4 << 20
#: Words are runs of digits, lower-cased letters and all that is no ASCII; any other byte is a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def feature_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split() if text else []


def suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``seq`` sorted by the ``depth`` numbers from there on, or more, by prefix doubling."""
    rank, have = seq, 1
    order = np.argsort(rank, kind="stable")
    while have < depth:
        ahead = np.concatenate((rank[have:], np.full(min(have, len(rank)), -1, rank.dtype)))
        order = np.lexsort((ahead, rank))
        new = np.concatenate(([0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(ahead[order]) != 0)))) if len(order) else order
        rank = np.empty_like(rank)
        rank[order] = new
        have *= 2
    return order


def common_prefixes(seq: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Words that each suffix shares with the one before it, ``depth`` at most; none beyond the end of a text."""
    padded = np.concatenate((seq, np.zeros(depth, seq.dtype)))
    shared, on = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    for d in range(depth):
        a, b = padded[order[1:] + d], padded[order[:-1] + d]
        on &= (a == b) & (a > 0)
        shared[1:] += on
    return shared


def bucket_features(block: list[list[bytes]], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every occurrence of every n-gram of up to ``longest`` words in a block of texts."""
    known: dict[bytes, int] = {}
    flat = [x for words in block for x in (*(known.setdefault(w, len(known) + 1) for w in words), 0)]
    seq, names = np.array(flat, np.int64), [b"", *known]
    text_of = np.repeat(np.arange(len(block)), [len(w) + 1 for w in block])
    order = suffix_order(seq, longest)
    shared = common_prefixes(seq, order, longest)
    ends = np.flatnonzero(seq == 0)
    left = ends[np.searchsorted(ends, order)] - order if len(order) else order  # words from a place to the end of its text
    owners, found = [], []
    for n in range(1, longest + 1):
        heads = np.flatnonzero(shared < n)
        sizes = np.diff(np.append(heads, len(order)))
        whole = left[heads] >= n
        heads, sizes = heads[whole], sizes[whole]
        hashed = [zlib.crc32(b" ".join([names[i] for i in seq[p : p + n].tolist()])) % buckets for p in order[heads].tolist()]
        before = np.cumsum(sizes) - sizes
        places = order[np.repeat(heads - before, sizes) + np.arange(int(sizes.sum()))]
        owners.append(text_of[places])
        found.append(np.repeat(np.array(hashed, np.int64), sizes))
    return np.concatenate(owners), np.concatenate(found)


def blocks(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The batch's texts as words, block by block, with the row number that each block starts with."""
    held, size, start = [], 0, 0
    for i, text in enumerate(texts(batch)):
        n = len(text or "")
        if held and size + n > limit:
            yield start, held
            held, size, start = [], 0, i
        held.append(feature_words(text))
        size += n
    if held:
        yield start, held


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, block: int = BLOCK) -> np.ndarray:
    """How often features of ``docs`` (text) fall into each bucket.

    Tasks sum their own counts before the shuffle; ``buckets`` numbers come to the driver, whatever the corpus.
    """

    def work(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, held in blocks(batch, block):
                total += np.bincount(bucket_features(held, longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(work, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and corpus, cut down to whole numbers."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """Noise in thousandths by which the highest scores are a draw without replacement; the id alone decides it (null: an empty one)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of ``docs`` (doc_id, text): the sum of gains, and with noise."""
    buckets = len(gain)

    def work(batches):
        for batch in batches:
            columns = [np.zeros(batch.num_rows, np.int64) for _ in range(3)]
            for start, held in blocks(batch, block):
                owner, bucket = bucket_features(held, longest, buckets)
                own = slice(start, start + len(held))
                columns[0][own] = [len(w) for w in held]
                columns[1][own] = np.bincount(owner, minlength=len(held))
                np.add.at(columns[2], start + owner, gain[bucket])
            noise = np.array([gumbel(i, seed) for i in batch.column("doc_id").to_pylist()], np.int64)
            arrays = [batch.column("doc_id"), *map(pa.array, (*columns, columns[2] + noise))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_features", "weight", "score"])

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return ids.mapInArrow(work, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def with_place(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place``, 1 for the first by ``order``, without bringing all rows into one task.

    Rows are dealt by ranges and sorted there; the result is written, so that places
    and the counts of the ranges, which say where each begins, are of one dealing. For
    ranges to split equal rows, ``order`` must tell all rows apart.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # range << 33, and the row's number in it
    ranges = cut(dealt.withColumns({"__range": F.shiftright(at, 33), "__at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    upto = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    begins = ranges.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(upto, F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at") + 1
    return ranges.join(F.broadcast(begins), "__range").withColumn("place", place).drop("__range", "__at", "__before")  # a row a partition


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all ``docs``; ``rank`` counts the drawn ones, highest score first, and is null for the rest.

    Drawn are ``per_cent`` of the documents with ``least_words`` words, cut down. Ties go
    to the smaller doc_id, null before all; rows of one id with the same score take
    places in order of their features and then of arrival. Null and empty texts have no
    features, weight 0 and are never drawn where ``least_words`` is positive. Repeated rows
    each take part. An empty table gives an empty one, an empty target evens all buckets;
    further columns are left out.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = cut(score_documents(docs, gain, longest, seed).withColumn("__row", F.monotonically_increasing_id()))
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * per_cent // 100
    placed = with_place(scored.where(fit), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").asc(), F.col("__row").asc())
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    out = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*out, rank.alias("rank")).unionByName(scored.where(~fit).select(*out, F.lit(None).cast("bigint").alias("rank")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their importance towards ``benchmark``; the drawn tenth has ranks."""
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same in DuckDB for single words: CRC-32 by a table that eight halvings make of each byte.
SQL = rf"""WITH RECURSIVE h(i, c, k) AS (SELECT i, CAST(i AS BIGINT), 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM h WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM h WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d), bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
v AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(w)), lambda i: CAST(concat('0x', substr(hex(encode(w)), CAST(2 * i + 1 AS INTEGER), 2)) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) % {BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), tab),
s AS (SELECT b, count(*) AS n FROM dw JOIN v USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM bw JOIN v USING (w) GROUP BY b),
tot AS (SELECT (SELECT count(*) FROM dw) + {BUCKETS} AS sa, (SELECT count(*) FROM bw) + {BUCKETS} AS ta),
g AS (SELECT s.b, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * sa AS DOUBLE) / CAST((s.n + 1) * ta AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), tot),
x AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN v USING (w) JOIN g USING (b) GROUP BY r),
y AS (SELECT d.r, doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, CAST(concat('0x', substr(sha256(concat('{SEED}:', doc_id)), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN x USING (r)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM y),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, r) AS k, count(*) OVER () AS n FROM z WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN k <= n * {PER_CENT} // 100 THEN k END AS rank FROM z LEFT JOIN p USING (r)"""
