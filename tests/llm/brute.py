"""Plain Python answers that the Spark operators are held against, and rows that are awkward."""

import hashlib
import re
from collections import Counter

import numpy as np
from xxhash import xxh64_intdigest

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: The last columns clash with names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id long, size int, shard int, score string, h string, part string, fp string"
LONG = " ".join(f"word{i} of{i % 97}" for i in range(60_000))
TEXTS = [
    (None, None, None), (None, "no id here at all", None), (1, "", "a"), (2, None, "a"), (3, "one two three four five six", "b"), (4, "one two three four five six", "b"),
    (4, "one two three four five six", "b"), (5, LONG, "c"), (6, LONG + " end", None), (7, "x", "a"), (8, "\t \n", "\U0001f600"), (9, "déjà vu ß 漢字 \U0001f600 one two", "b"),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, None, s, None, 0, 1, 99, "s", "h", "p", "f") for i, t, s in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def simhash(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids, most=4):
    """Least id of each fingerprint's group, by comparing all pairs."""
    fps = np.array(fps, np.uint64)
    group = list(range(len(fps)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= most):
            a, b = find(i), find(i + 1 + int(j))
            group[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    return [least[find(i)] for i in range(len(fps))]


def repeated_bytes(texts, length=400):
    """(bytes, removed, spans, sha256 of the rest) of each text, by counting every string."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        hit = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        gone = np.cumsum(hit)[: len(r)] > 0
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(r) else 0
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def leaks(docs, items, threshold=0.8):
    """{(doc_id, item_id)} by comparing all shingle sets."""
    cut = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = set()
    for i, t in docs:
        for j, b in items:
            w = words(b)
            n = min(5, len(w))
            if n and len(cut(w, n) & cut(words(t), n)) >= threshold * len(cut(w, n)):
                out.add((i, j))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same_as_sql(df, sql, sf_dir, tables):
    """Whether a result has the rows of DuckDB's answer to ``sql``."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    mine, theirs = df.toPandas(), con.execute(sql).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    key = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    return key(mine) == key(theirs)
