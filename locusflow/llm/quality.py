"""Quality scores by histogram gradient-boosted trees over document statistics.

Trees are complete and flattened into arrays; a batch of documents walks all
levels at once with numpy. Statistics are of the whole text; language, source and
ids are no inputs.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.llm.common import documents, texts
from locusflow.llm.training import crc_mod, labels, sample_texts

#: Labelled documents to learn from at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_HESSIAN, L2 = 80, 4, 64, 0.15, 3.0, 1.0
THRESHOLD = 0.3
_CLASS = np.zeros(256, np.int64)
for _i, _group in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:'\"-()", b"!?", b"#$%&*@^~", b"|<>/\\_=+{}[]`")):
    _CLASS[list(_group)] = _i + 1
_CLASS[128:] = 10
N_CLASSES = 11
FEATURES = [
    *(f"share_{c}" for c in ("other", "lower", "upper", "digit", "blank", "line", "stop", "shout", "symbol", "markup", "high")),
    "log_bytes", "byte_entropy", "log_words", "word_len", "distinct_words", "repeated_neighbours", "words_per_line", "distinct_lines", "upper_to_letters", "top_byte",
]


def statistics(text: str | None) -> list[float]:
    """The numbers that trees see of a text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    share = np.bincount(_CLASS, hist, N_CLASSES) / n
    p = hist[hist > 0] / n
    words, lines = raw.split(), raw.split(b"\n")
    k = max(1, len(words))
    letters = share[1] + share[2]
    return [
        *share.tolist(), np.log1p(n), float(-(p * np.log2(p)).sum()), np.log1p(len(words)), n / k, len(set(words)) / k, sum(map(eq, words, words[1:])) / k,
        len(words) / len(lines), len(set(lines)) / len(lines), share[2] / letters if letters else 0.0, float(np.delete(hist, 32).max() / n),
    ]


@dataclass
class Boosted:
    """Complete trees as arrays: inner nodes' feature and threshold, leaves' values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, all rows and one level at a time."""
        z, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            z += v[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-z))


def train_boosted(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Logistic boosting over histograms of at most BINS quantile bins; without both labels, a constant."""
    mean = (y.sum() + 1) / (len(y) + 2)
    start, n_inner = float(np.log(mean / (1 - mean))), 2**DEPTH - 1
    model = ([], [], [])
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1)
        flat, d = binned + np.arange(x.shape[1]) * BINS, x.shape[1]
        z = np.full(len(y), start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
            feature, threshold = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf)
            for level in range(DEPTH):
                first = 2**level - 1
                at = ((node - first)[:, None] * (d * BINS) + flat).ravel()
                hg, hh = (np.bincount(at, np.repeat(v, d), 2**level * d * BINS).reshape(-1, d, BINS).cumsum(2) for v in (g, h))
                ag, ah = hg[:, :, -1:], hh[:, :, -1:]
                gain = hg**2 / (hh + L2) + (ag - hg) ** 2 / (ah - hh + L2) - ag**2 / (ah + L2)
                gain[(hh < LEAST_HESSIAN) | (ah - hh < LEAST_HESSIAN)] = 0
                best = gain.reshape(len(gain), -1).argmax(1)
                for i, b in enumerate(best):
                    f, c = divmod(int(b), BINS)
                    if gain[i, f, c] > 1e-6 and c < len(cuts[f]):
                        feature[first + i], threshold[first + i] = f, cuts[f][c]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
            leaf = node - n_inner
            value = -RATE * np.bincount(leaf, g, n_inner + 1) / (np.bincount(leaf, h, n_inner + 1) + L2)
            z += value[leaf]
            for part, v in zip(model, (feature, threshold, value), strict=True):
                part.append(v)
    shape = lambda v, n, t: np.array(v, t).reshape(-1, n)
    return Boosted(shape(model[0], n_inner, np.int64), shape(model[1], n_inner, float), shape(model[2], n_inner + 1, float), start)


def statistics_rows(docs: DataFrame) -> DataFrame:
    """``docs`` (text, others) with the text replaced by ``x``, its statistics."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in kept]

    def run(batches):
        for b in batches:
            x = pa.array([statistics(t) for t in texts(b)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), x], names=[*names, "x"])

    return docs.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "x array<double>"]))


def learn(docs: DataFrame, marks: DataFrame, train: Column, sample: int = SAMPLE) -> Boosted:
    """Trees from at most ``sample`` labelled rows, whose statistics (a few hundred bytes each) come to the driver."""
    rows = statistics_rows(sample_texts(docs, marks, "quality", train, sample)).orderBy("doc_id").collect()
    return train_boosted(np.array([r.x for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.y for r in rows], float))


def score_quality(docs: DataFrame, model: Boosted, name: str = "score") -> DataFrame:
    """``docs`` with the score as column ``name``, in the place of any of that name.

    Null and empty texts score as texts of nothing but zeros.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TREES trees of 2^DEPTH nodes
    docs = docs.drop(name)
    names = docs.columns

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in texts(b)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(x))], names=[*names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields]).add(name, "double"))


def train_rows() -> Column:
    return crc_mod(F.col("doc_id"), 5) != 0


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by trees that never saw held-out labels.

    Repeated rows score alike; without labels all rows get the same score; an
    empty table gives no rows.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score_quality(docs, learn(docs, labels(spark, sf_dir), train_rows()))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_low_quality(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The documents whose score is at least THRESHOLD, with their columns."""
    return score_quality(docs, learn(docs, marks, train_rows()), "__score").where(F.col("__score") >= THRESHOLD).drop("__score")
