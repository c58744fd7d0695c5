"""Toxicity behind disguises: noisy-channel restoration, then scores of the restored words.

A token with digits or symbols between its letters, drawn-out letters, or letters
set apart by blanks is a noisy reading of a plain one. Its readings form a lattice
(leetspeak, dropped separators, shortened runs); Viterbi search under a character
trigram model of the whole corpus takes the likeliest. Scores come from words and
word beginnings that mark toxic documents among labelled ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.common import documents, texts
from locusflow.llm.training import crc_mod, labels, sample_texts

# Letters that a disguising character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e"}
#: Costs (negative log probabilities) of the channel.
LEET_COST, DROP_COST, ONCE_COST, TWICE_COST, BREAK_COST = 1.0, 0.7, 0.2, 0.9, 2.5
#: A character that may be a letter is left out at this further cost, above the price of a letter: else short readings would win.
LOST_COST = 8.0
#: Symbols of the character model: 0 is a word's edge, 1-26 letters, 27-31 classes of others.
SYMBOLS = 32
#: Labelled documents to learn from at most, and marks to keep at most.
SAMPLE, MARKS = 20_000, 50_000
#: A mark is kept if it is in LEAST toxic documents and its rate, with PRIOR clean documents added, is RATE at least.
LEAST, PRIOR, RATE = 4, 2.0, 0.5
#: A word is marked if its best mark has this rate.
MARKED = 0.8
BEGINNINGS = range(3, 8)
THRESHOLD, EVIDENCE = 0.3, 7
CACHE = 200_000
#: Longer tokens are decoded anew each time, so that the memory of tokens stays small.
KEPT = 100
_STRIP = re.compile(r"^[\W_]+|[\W_]+$")
#: Symbols at a token's edges that can be no letters.
_EDGE = re.compile(_STRIP.pattern.replace(r"[\W_]", rf"(?:(?![{re.escape(''.join(LEET))}])[\W_])"))
_RUN = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)(?:\S[ ]){2,}\S(?!\S)")
#: Letters set apart by several blanks or by tabs, all of them.
_WIDE = re.compile(r"(?<!\S)(?:\S(?:[ ]{2,}|[ ]*\t[ \t]*)){2,}\S(?!\S)")


def _symbols() -> np.ndarray:
    """Symbol of each code point below 0x600: accents fold to their letter, other letters to a class."""
    out = np.zeros(0x600, np.int64)
    for c in range(0x600):
        base = unicodedata.normalize("NFKD", chr(c).lower())[:1]
        out[c] = ord(base) - 96 if "a" <= base <= "z" else 27 + c % 5 if chr(c).isalpha() else 0
    return out


SYMBOL_OF = _symbols()


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.where(c < len(SYMBOL_OF), SYMBOL_OF[np.minimum(c, len(SYMBOL_OF) - 1)], 27 + c % 5)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(g, n): counts of symbol trigrams over all texts; each task sends its SYMBOLS^3 sums."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for t in texts(b):
                if t:
                    s = np.concatenate(([0, 0], symbols(t), [0]))
                    total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["g", "n"])

    return docs.select("text").mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """-log P(symbol | two before), SYMBOLS^3 numbers: trigrams backed by bigrams, from all documents."""
    n = np.zeros(SYMBOLS**3)
    for r in trigram_counts(docs).collect():
        n[r.g] = r.n
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = n.sum(0) + 0.1
    two /= two.sum(1, keepdims=True)
    three = (n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5)
    return -np.log(three)


def steps(token: str) -> list[list[tuple[int, str, float]]]:
    """The lattice of a token: per place its arcs (next place, letters read, cost)."""
    out, ends = [], list(range(1, len(token) + 1))
    for i in range(len(token) - 2, -1, -1):
        if token[i] == token[i + 1]:
            ends[i] = ends[i + 1]
    for i, c in enumerate(token):
        arcs, j = [], ends[i]
        if c.isalpha():
            if j - i >= 3:
                arcs += [(j, c, ONCE_COST), (j, c * 2, TWICE_COST)]
            else:
                arcs.append((i + 1, c, 0.0))
        elif c == " ":
            arcs += [(i + 1, "", DROP_COST), (i + 1, " ", BREAK_COST)]
        else:
            arcs += [(i + 1, x, LEET_COST) for x in LEET.get(c, "")]
            if c in LEET and j - i >= 3:  # drawn out as letters are
                arcs += [arc for x in LEET[c] for arc in ((j, x, LEET_COST + ONCE_COST), (j, x * 2, LEET_COST + TWICE_COST))]
            arcs.append((i + 1, "", DROP_COST + (LOST_COST if c in LEET else 0.0)))
        out.append(arcs)
    return out


def _first(p: tuple | None, q: tuple | None) -> bool:
    """Whether reading ``p`` sorts before ``q``; both are chains (number of letters, letter, chain before)."""
    m, n, less = p[0] if p else 0, q[0] if q else 0, False
    shorter = m < n
    while p and p[0] > n:
        p = p[2]
    while q and q[0] > m:
        q = q[2]
    same = True
    while p is not q:
        if p[1] != q[1]:
            same, less = False, p[1] < q[1]
        p, q = p[2], q[2]
    return shorter if same else less


def viterbi(token: str, lm) -> str:
    """The likeliest plain reading of a token; ties go to the reading that sorts first.

    A place has at most SYMBOLS^2 states, and a state points back to the letter
    before, so time and memory are in proportion to the token's length.
    """
    lattice = steps(token)
    best: dict[int, dict] = {0: {(0, 0): (0.0, None)}}
    sym = lambda x: 0 if x == " " else int(SYMBOL_OF[ord(x)]) if ord(x) < len(SYMBOL_OF) else 27 + ord(x) % 5
    known = {x: sym(x) for arcs in lattice for _, letters, _ in arcs for x in letters}
    for i, arcs in enumerate(lattice):
        for (a, b), (cost, read) in best.pop(i, {}).items():
            for j, letters, price in arcs:
                x, y, c, r = a, b, cost + price, read
                for letter in letters:
                    s = known[letter]
                    c, x, y, r = c + lm[x][y][s], y, s, (r[0] + 1 if r else 1, letter, r)
                at = best.setdefault(j, {})
                old = at.get((x, y))
                if old is None or c < old[0] or c == old[0] and _first(r, old[1]):
                    at[(x, y)] = (c, r)
    end = None
    for (x, y), (c, r) in best[len(token)].items():
        c += lm[x][y][0]
        if end is None or c < end[0] or c == end[0] and _first(r, end[1]):
            end = (c, r)
    out, read = [], end[1]
    while read:
        out.append(read[1])
        read = read[2]
    return "".join(reversed(out))


class Restorer:
    """Plain readings of texts, with a bounded memory of tokens."""

    def __init__(self, lm: np.ndarray):
        self.lm, self.known = lm.tolist(), {}  # plain lists are faster to look up one by one

    def token(self, raw: str) -> str:
        """Plain words stay as they are, all else is decoded; symbols at the edges may be letters or go."""
        if raw.isalpha() and not _RUN.search(raw):
            return raw
        t = _EDGE.sub("", raw)
        if t.isalpha() and not _RUN.search(t):
            return t
        return viterbi(t, self.lm) if any(map(str.isalnum, t)) else ""

    def readings(self, raw: str) -> tuple[str, ...]:
        """The plain reading, and the word between edges of symbols that the reading took for letters."""
        if raw.isalpha() and not _RUN.search(raw):
            return (raw,)
        bare = _STRIP.sub("", raw)
        whole = bare.isalpha() and not _RUN.search(bare)
        if whole and LEET.keys().isdisjoint(raw):
            return (bare,)
        return tuple(filter(None, (self.token(raw), bare if whole else "")))

    def words(self, text: str | None) -> set[str]:
        """Distinct restored words of a whole text, lower-cased."""
        low = (text or "").lower()
        tokens = set(low.split())
        out = set()
        if any(len(t) == 1 for t in tokens):
            for m in _SPACED.finditer(low):
                out.update(viterbi(m.group(), self.lm).split())
            for m in _WIDE.finditer(low):
                out.update(viterbi(" ".join(m.group().split()), self.lm).split())
        for t in tokens:
            w = self.known.get(t)
            if w is None:
                if len(self.known) >= CACHE:
                    self.known.clear()
                w = self.readings(t)
                if len(t) <= KEPT:
                    self.known[t] = w
            out.update(w)
        return out


def marks_of(words: set[str]) -> set[str]:
    """Words and, marked by ^, beginnings of longer words."""
    out = set(words)
    for w in words:
        if len(w) > 4:
            out.update("^" + w[:k] for k in BEGINNINGS if k < len(w))
    return out


def mark_counts(rows: DataFrame, lm: np.ndarray) -> DataFrame:
    """(mark, pos, neg): labelled documents with each mark; a task sums up before it sends, in bounded pieces."""
    shared = rows.sparkSession.sparkContext.broadcast(lm)

    def run(batches):
        r, pos, neg = Restorer(shared.value), Counter(), Counter()

        def flush():
            keys = list(pos.keys() | neg.keys())
            got = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["mark", "pos", "neg"])
            pos.clear()
            neg.clear()
            return got

        for b in batches:
            for t, y in zip(texts(b), b.column("y").to_pylist(), strict=True):
                (pos if y else neg).update(marks_of(r.words(t)))
                if len(pos) + len(neg) > CACHE:
                    yield flush()
        yield flush()

    return rows.select("y", "text").mapInArrow(run, "mark string, pos long, neg long").groupBy("mark").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


@dataclass
class Scorer:
    """Rates of marks, and a logistic curve over a document's evidence."""

    lm: np.ndarray
    counts: dict[str, tuple[int, int]]
    curve: np.ndarray

    def evidence(self, words: set[str], out: int | None = None) -> list[float]:
        """EVIDENCE numbers: the three best rates over words, marked words by number and by share,
        the sum of -log(1 - rate) of the best eight, and the number of words.

        ``out`` is the label of a training document, whose own share is taken out.
        """
        found = []
        for w in words:
            best = 0.0
            for m in (w, *("^" + w[:k] for k in BEGINNINGS if len(w) > 4 and k < len(w))):
                got = self.counts.get(m)
                if got:
                    pos, neg = got[0] - (out == 1), got[1] - (out == 0)
                    best = max(best, pos / (pos + neg + PRIOR))
            if best:
                found.append(best)
        found.sort(reverse=True)
        n = sum(x >= MARKED for x in found)
        best = [*found[:3], 0.0, 0.0, 0.0][:3]
        return [*best, float(np.log1p(n)), 10.0 * n / max(1, len(words)), float(-np.log1p(-np.array(found[:8])).sum()), float(np.log1p(len(words)))]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + x @ self.curve[1:])))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the constant is not shrunk."""
    x = np.column_stack((np.ones(len(x)), x))
    w, ridge = np.zeros(x.shape[1]), l2 * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(25 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def learn(docs: DataFrame, marks: DataFrame, sample: int = SAMPLE) -> Scorer:
    """A scorer from the whole corpus's letters and at most ``sample`` labelled rows."""
    lm = language_model(docs)
    rows = sample_texts(docs, marks, "toxic", crc_mod(F.col("doc_id"), 4) != 2, sample).cache()
    rate = F.col("pos") / (F.col("pos") + F.col("neg") + PRIOR)
    kept = mark_counts(rows, lm).where((F.col("pos") >= LEAST) & (rate >= RATE)).orderBy(rate.desc(), "mark").limit(MARKS)
    scorer = Scorer(lm, {r.mark: (r.pos, r.neg) for r in kept.collect()}, np.zeros(EVIDENCE + 1))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        r = Restorer(shared.value.lm)
        for b in batches:
            y = b.column("y").to_pylist()
            x = [shared.value.evidence(r.words(t), k) for t, k in zip(texts(b), y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.select("y", "text").mapInArrow(run, "y int, x array<double>").groupBy("y", "x").count().collect()
    rows.unpersist()
    got.sort(key=lambda r: (r.x, r.y))
    n = [r["count"] for r in got]
    x, y = np.repeat(np.array([r.x for r in got], float).reshape(-1, EVIDENCE), n, axis=0), np.repeat([r.y for r in got], n)
    return Scorer(lm, scorer.counts, logistic(x, y.astype(float)))


def score_toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score) of each whole text.

    Null and empty texts score as texts without marks; repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # SYMBOLS^3 numbers and MARKS marks at most

    def run(batches):
        s, r = shared.value, Restorer(shared.value.lm)
        for b in batches:
            x = np.array([s.evidence(r.words(t)) for t in texts(b)], float).reshape(-1, EVIDENCE)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s.score(x))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def restore_texts(docs: DataFrame, lm: np.ndarray) -> DataFrame:
    """(doc_id, restored): each text with its tokens in their plain readings."""
    shared = docs.sparkSession.sparkContext.broadcast(lm)

    def run(batches):
        r = Restorer(shared.value)
        for b in batches:
            out = []
            for t in texts(b):
                low = _SPACED.sub(lambda m: viterbi(m.group(), r.lm), t.lower()) if t is not None else None
                out.append(None if low is None else " ".join(filter(None, map(r.token, low.split()))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "restored"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, restored string")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score_toxicity(docs, learn(docs, labels(spark, sf_dir)))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
