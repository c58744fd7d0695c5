"""Passages of over 50 words that several documents have, against brute force."""

import os

import numpy as np
import pyarrow as pa
import pytest

from locusflow.llm import passages, registry
from tests.llm import brute

D = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")


def sharing(rows, length=51):
    """1 for each (doc_id, text) with a passage that a row of another id or text has too, else 0."""
    cuts = [{tuple(w[k : k + length]) for k in range(len(w) - length + 1)} for w in ((t or "").encode().split() for _, t in rows)]
    own = {}
    for row, found in zip(rows, cuts, strict=True):
        for p in found:
            own.setdefault(p, set()).add(row)
    return [int(any(len(own[p]) > 1 for p in found)) for found in cuts]


@needs_data
def test_query_tells_shared_passages(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    removed = brute.repeated_bytes([t for _, t in docs])
    expected = sorted((i, *x, s) for (i, _), x, s in zip(docs, removed, sharing(docs), strict=True))
    got = registry.queries()["op5_suffix_dedup"](spark, D)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage"]
    assert sorted(map(tuple, got.collect())) == expected


def made_rows():
    rng = np.random.default_rng(11)
    words = [f"w{x}" for x in range(60)] + ["ß", "漢字"]
    noise = lambda n: list(rng.choice(words, n))
    p = [noise(n) for n in (51, 50, 51, 120, 51, 300, 30)]
    text = lambda *parts: " ".join(x for part in parts for x in part)
    rows = [
        text(noise(30), p[0], noise(9)), text(p[0]), text(noise(70), p[0]).replace(" ", "\n\t "),  # under 400 bytes; other blanks
        text(noise(40), p[1], noise(40)), text(noise(5), p[1], noise(60)),  # one word too few
        text(p[2], noise(20), p[2]),  # in one document only
        text(p[3], noise(50)), text(noise(10), p[3][:80], ["x"], p[3][81:]), text(noise(80), p[3][90:], noise(3)),  # the last shares 30 words
        "  " + text(p[4]) + " \x0b", text(noise(99)), text(["the"] * 51), text(["the"] * 200), text(["la"] * 100), None, "", " ",
        text(p[5]), text(p[5]), text(p[6] * 4), text(noise(20), p[6], p[6]),
    ]
    long = noise(90_000)
    rows += [text(long), text(noise(40), long[44_000:44_051], noise(40)), text(noise(9), long[70_000:70_050], noise(9)), "z" * 400_000 + " " + text(p[0])]
    return [(i, t) for i, t in enumerate(rows)]


def test_shared_passages_of_made_texts(spark):
    rows = made_rows()
    rows += [(3, rows[5][1]), (7, "once " + rows[10][1][5:]), (70, rows[13][1]), (70, rows[13][1]), (71, "a lone row that stands twice " + "b c d e f " * 30), (71, "a lone row that stands twice " + "b c d e f " * 30), (None, rows[9][1])]
    got = passages.dedup_report(brute.frame(spark, [(i, t, "s") for i, t in rows])).collect()
    want = sharing(rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.shares_passage) for r in got) == sorted((i if i is not None else -1, len((t or "").encode()), s) for (i, t), s in zip(rows, want, strict=True))
    assert want[:9] == [1, 1, 1, 0, 0, 1, 1, 1, 0] and want[22:25] == [1, 0, 1]
    assert passages.dedup_report(brute.frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [1, 300, 5000])
def test_pieces_have_each_passage_once(monkeypatch, block):
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "bc", "def", "ghijklmnop", "q" * 900], n, p=(0.3, 0.3, 0.2, 0.19, 0.01))) for n in (400, 51, 50, 1300, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    found = []
    for held in passages.blocks(batch):
        text, at, size, _, _ = passages.parse([x[2] for x in held])
        for k, a, n in zip(text, at, size, strict=True):
            i, offset, _ = held[k]
            words = texts[i].encode()[a + offset : a + offset + n].split()
            before = len(texts[i].encode()[: a + offset].split())
            found += [(i, before + j) for j in range(len(words) - passages.PASSAGE + 1)]
    assert sorted(found) == [(i, j) for i, t in enumerate(texts) for j in range(len(t.split()) - passages.PASSAGE + 1)]
