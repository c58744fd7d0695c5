"""Chat formatting, importance resampling and periodic runs, against plain Python and DuckDB."""

import hashlib
import json
import math
import os
import random
from collections import Counter
from fractions import Fraction
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusflow.llm import chat, periodic, registry, resampling

D = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
DOC, TURN = "doc_id bigint, text string, lang string, n_words string", "conv_id bigint, turn bigint, role string, text string"


def table(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


@needs_data
@pytest.mark.parametrize("name", ["op11_chat_format", "op12_importance_resampling"])
def test_equal_to_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    rows = registry.queries()[name](spark, D)
    assert set(names) == set(rows.columns)
    assert table(rows.collect(), *names) == table([dict(zip(names, r, strict=True)) for r in got.fetchall()], *names)


# --- chat -------------------------------------------------------------------------

LAID_OUT = [
    ({"conv_id": 1, "turn": 4, "role": "user", "text": "a"}, "turn rows", [(4, "user", "a")]),
    ({"text": None, "role": None, "turn": None, "conv_id": None}, "turn rows", [(None, "", "")]),
    ({"id": 2, "messages": [{"role": "system", "content": "s"}, {"content": None, "role": "assistant"}]}, "messages", [(0, "system", "s"), (1, "assistant", "")]),
    ({"id": 3, "messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]}, "message parts", [(0, "user", "xy")]),
    ({"id": 4, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}, {"from": "tool", "value": "t"}]}, "from and value", [(0, "user", "q"), (1, "assistant", "r"), (2, "tool", "t")]),
    ({"id": 5, "dialog": {"turns": [{"speaker": "bot", "utterance": "u"}]}}, "speakers", [(0, "assistant", "u")]),
    ({"id": 6, "instruction": "i", "input": "n", "output": "o"}, "instruction", [(0, "user", "i"), (1, "user", "n"), (2, "assistant", "o")]),
    ({"id": 7, "instruction": "i", "output": "o", "system": "s"}, "plain instruction", [(0, "system", "s"), (1, "user", "i"), (2, "assistant", "o")]),
    ({"id": 8, "prompt": "p", "response": {"a": 1}}, "prompt and response", [(0, "user", "p"), (1, "assistant", '{"a": 1}')]),
    ({"id": 9, "prompt": "p", "completion": "c", "meta": {"k": [1]}}, "prompt and completion", [(0, "user", "p"), (1, "assistant", "c")]),
    ({"id": 10, "question": "q", "answer": "a"}, "question and answer", [(0, "user", "q"), (1, "assistant", "a")]),
    ({"id": 11, "messages": []}, None, None),
    ({"id": 12, "what": "else"}, None, None),
]


def test_layouts_by_fingerprint(spark):
    records = [json.dumps(r) for r, _, _ in LAID_OUT] + [None, "no json", "[1]", "3"]
    rows = chat.canonical_turns(spark.createDataFrame([(x, "z") for x in records], "record string, layout string")).collect()
    i = 0
    for record, layout, turns in LAID_OUT:
        for turn in turns or [(None, None, json.dumps(record))]:
            r = rows[i]
            assert (r.layout, r.turn, r.role, r.text, r.conv_id) == (layout, *turn, record.get("conv_id", record.get("id")))
            i += 1
    assert [(r.layout, r.text, r.conv_id) for r in rows[i:]] == [(None, x, None) for x in records[-4:]]


def test_fingerprints_tell_fields_only():
    mark = lambda r: chat.fingerprint(frozenset(chat.field_paths(r)))
    assert mark({"a": 1, "b": [{"c": "x"}]}) == mark({"b": [{"c": None}, {"c": 2}], "a": []} | {"a": "y"})
    assert mark({"a": {"b": 1}}) != mark({"a": 1, "b": 1}) and mark({"a": [1]}) != mark({"a": 1})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["\\", "#", "<", "/turn>", ":", " ", "\n", "lhcn", "é", "\U0001f600", "</turn>\n", "### assistant: "]), max_size=14).map("".join), st.text(alphabet="us#:\\<\n ", max_size=6))
def test_escapes_are_reversible(text, role):
    body = chat.escaped(text)
    assert "</turn>" not in body and "###" not in body and chat.plain(body) == text
    marked = f"{chat.OPEN}{chat.escaped_role(role)}{chat.COLON}{body}{chat.END}"
    assert chat.parsed(marked * 2) == [(role, text)] * 2


def plain_chat(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digest = lambda t, said, size: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(said), sha(said), size)
    size = lambda t: sum(len(f"### {chat.escaped_role(r)}: {chat.escaped(x)}</turn>\n") for r, x in t)
    return {c: digest(t, "".join(x for r, x in t if r == "assistant"), size(t)) for c, t in out.items()}


@pytest.mark.parametrize("part", [1, 40, 1 << 20])
def test_formatting_reads_back(spark, part):
    rng = random.Random(part)
    words = ["</turn>", "### user: ", "\\", "ü", "####", "a\nb", "\\h", "<", " "]
    some = lambda: rng.choice([None, "", "".join(rng.choices(words, k=rng.randrange(9)))])
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1, 2]), rng.choice(["user", "assistant", None, "a:b"]), some()) for _ in range(60)] + [(9, i, "assistant", "long " * 50) for i in range(300)]
    formatted = chat.format_turns(spark.createDataFrame([(*r, "x") for r in rows], TURN + ", part string"), part)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.read_back(formatted).collect()}
    assert got == plain_chat(rows)
    assert (formatted.where("part > 0").count() > 200) == (part < 1000)


def test_no_conversations(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], TURN))).collect() == []


# --- resampling --------------------------------------------------------------------

TEXTS = [(1, "the cat sat on the mat and the cat sat"), (2, "Zebra zebra ZEBRA! one-two 3"), (3, None), (4, ""), (5, "the cat, the cat; the cat"), (None, "ein Ünding im ünding"), (1, "the cat sat on the mat and the cat sat"), (7, "..."), (8, "dog " * 3000)]


def plain_resample(docs, target, longest, buckets, least, per_cent):
    def grams(text):
        w = resampling.feature_words(text)
        return len(w), [crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    corpus, aim = Counter(b for _, t in docs for b in grams(t)[1]), Counter(b for t in target for b in grams(t)[1])
    s_all, t_all = sum(corpus.values()) + buckets, sum(aim.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * s_all / ((corpus[b] + 1) * t_all)))
    rows = []
    for i, t in docs:
        n, g = grams(t)
        weight = sum(map(gain, g))
        rows.append([i, len(g), weight, weight + resampling.gumbel(i, 7), n >= least])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: len(fit) * per_cent // 100])}
    return [{"doc_id": r[0], "n_features": r[1], "weight": r[2], "score": r[3], "rank": ranks.get(id(r))} for r in rows]


@pytest.mark.parametrize("longest,least", [(1, 0), (2, 3), (3, 1)])
def test_resampling_equals_plain_counting(spark, longest, least):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in TEXTS], DOC)
    aim = ["zebra one two", None, "the cat"]
    got = resampling.resample(docs, spark.createDataFrame([(x,) for x in aim], "text string"), longest, 50, least, 60, 7).collect()
    names = ("doc_id", "n_features", "weight", "score", "rank")
    assert table(got, *names) == table(plain_resample(TEXTS, aim, longest, 50, least, 60), *names)


def test_resampling_blocks_and_empty_tables(spark):
    """Blocks cut the work, not the result; nothing in gives nothing out."""
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in TEXTS], DOC).coalesce(1)
    one, many = (resampling.bucket_counts(docs, 3, 97, block).tolist() for block in (1 << 20, 1))
    assert one == many and sum(one) > 0
    empty = docs.where("false")
    assert resampling.resample(empty, docs).collect() == []
    assert {r.weight for r in resampling.resample(docs.where("doc_id = 3"), empty).collect()} == {0}


def test_places_split_equal_rows(spark):
    """A thousand equal keys among two thousand: every range is used and places are those of one sort."""
    rows = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 97).cast("bigint").alias("k"), "id")
    got = [(r.place, r.k, r.id) for r in resampling.with_place(rows, F.col("k").desc(), F.col("id").asc()).collect()]
    want = sorted(((5 if i % 2 == 0 else i % 97, i) for i in range(2000)), key=lambda r: (-r[0], r[1]))
    assert sorted(got) == [(n + 1, *r) for n, r in enumerate(want)]


# --- periodic runs -----------------------------------------------------------------


def plain_runs(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(all(w[k] == w[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_plain_search():
    rng = random.Random(5)
    for t in range(600):
        n, k = rng.randrange(260), rng.choice([1, 2, 3, 40])
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n > 30:
                a, e = sorted((rng.randrange(n), rng.randrange(n + 1)))
                p = rng.randrange(1, (n - a) // 3 + 2)
                w[a:e] = [w[a + (i - a) % p] for i in range(a, e)]
        for least, times in ((24, 3), (6, 3), (10, 5)):
            assert periodic.find_runs(w, least, times) == plain_runs(w, least, times), (t, least, times)


def test_lags_behind_known_runs_are_not_lost():
    """Runs inside runs, and a longer period that is a multiple of a shorter one elsewhere."""
    inner = [b"a"] * 30 + [b"b"]
    w = inner * 5 + [b"x"] * 7 + ([b"a", b"b"] * 20 + [b"c"]) * 4 + [b"%d" % i for i in range(40)] * 3
    assert periodic.find_runs(w) == plain_runs(w)
    assert {q for _, _, q in periodic.find_runs(w)} >= {1, 2, 31, 40, 41}
    with pytest.raises(ValueError):
        periodic.find_runs(w, 24, 2)


def plain_row(doc_id, text):
    w = periodic.planted((text or "").encode().split(), doc_id)
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s).hexdigest()
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


@needs_data
def test_runs_query_equals_plain_search(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").where(F.length("text") < 6000)
    odd = spark.createDataFrame([(None, "x " * 50), (-1, None), (-2, ""), (-3, " \t\n"), (-4, "a b " * 900 + "c"), (-4, "a b " * 900 + "c"), (-5, "é é é é " * 30)], "doc_id bigint, text string")
    docs.select("doc_id", "text").unionByName(odd).withColumn("runs", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    got = periodic.op13_periodic_runs(spark, str(tmp_path)).collect()
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    want = [dict(zip(names, plain_row(r.doc_id, r.text), strict=True)) for r in rows]
    assert table(got, *names) == table(want, *names)
    assert sum(r.n_runs > 0 for r in got) > 15


def test_runs_of_an_empty_table(spark):
    assert periodic.collapse_runs(spark.createDataFrame([], DOC)).collect() == []
