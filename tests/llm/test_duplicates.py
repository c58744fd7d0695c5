"""Near-duplicates, repeated strings, benchmark passages and fingerprints against brute force."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import decontaminate, fingerprint, simhash, suffix_dedup
from tests.llm import brute

D = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")


def table(spark, name="documents"):
    return spark.read.parquet(f"{D}/{name}.parquet")


@needs_data
def test_simhash_query(spark):
    docs = sorted((r.doc_id, r.text) for r in table(spark).select("doc_id", "text").collect())
    fps = [brute.simhash(t) for _, t in docs]
    least = brute.components(fps, [i for i, _ in docs])
    expected = sorted((i, f"{fp:016x}", c) for (i, _), fp, c in zip(docs, fps, least, strict=True))
    assert sorted(map(tuple, simhash.op10_simhash(spark, D).collect())) == expected


@pytest.mark.parametrize(("cell_variants", "cluster"), [(3_000, 0), (3_000, 90), (simhash.CELL_VARIANTS, 0)])
def test_links_connect_all_within_distance_four(spark, cell_variants, cluster):
    """Random fingerprints with chains of neighbours; small cells force the finer cut."""
    rng = np.random.default_rng(7)
    fps = set(rng.integers(0, 1 << 63, 60).tolist())
    for fp in sorted(fps)[:25]:
        for step in (1, 3, 4, 5):
            fp ^= sum(1 << int(b) for b in rng.choice(64, step, replace=False))
            fps.add(fp)
    fps |= {min(fps) ^ int(x) << 2 * (int(x) % 9) for x in rng.integers(1, 1 << 12, cluster)}  # equal in their leading bits, so cut several times
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.near_links(nodes, len(fps), cell_variants).collect()
    group = {x: x for x in signed}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        group[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(x) for x in signed] == brute.components(fps, signed)


def test_near_duplicates_of_awkward_rows(spark):
    docs = brute.frame(spark)
    got = {(r.id, r.fp): r.component for r in simhash.near_duplicates(docs).collect()}
    by_id = {i: c for (i, _), c in got.items()}
    assert by_id[3] == by_id[4] == 3 and by_id[5] == by_id[6] == 5
    assert by_id[1] == by_id[2] == by_id[8] == 1  # no words: fingerprint zero
    assert len(got) == 11  # two rows without id have ids of their own; the repeated row counts once here
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text and len(r.text) < 99) == [(0, "no id here at all"), (3, brute.TEXTS[4][1]), (7, "x"), (9, brute.TEXTS[11][1])]


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    """An id stays in each group that it leads; copies go whatever their id, and equal rows leave one."""
    one, two = "one two three four five six", "alpha beta gamma delta epsilon zeta eta"
    docs = brute.frame(spark, [(3, one, "s"), (5, two, "s"), (5, one, "s")])
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == [(3, one), (5, two)]
    docs = brute.frame(spark, [(1, "b c d e f g h", "s"), (1, "a x y z u v w", "s"), (2, "q r s t u v w x y z", "s"), (2, "q r s t u v w x y z", "s"), (2, "q r s t u v w x y z", "t"), (7, "a x y z u v w", "t")])
    kept = simhash.keep_one(docs)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a x y z u v w"), (1, "b c d e f g h"), (2, "q r s t u v w x y z")]
    assert brute.rows_of(kept) == brute.rows_of(simhash.keep_one(docs.repartition(3)))


def test_keep_one_of_many_rows(spark):
    """A third of the rows under one id and text, another third near copies, against brute force over (id, text)."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 900, 400)]
    rows = [(7, "same words in every row of this id", "s")] * 150
    rows += [(100 + i, " ".join([*base[: 2 * i], "x", *base[2 * i + 1 :]]), "s") for i in range(150)] + [(int(rng.integers(0, 40)), f"other words {i} {i * 7} {i * 5} text", "s") for i in range(150)]
    kept = sorted((r.doc_id, r.text) for r in simhash.keep_one(brute.frame(spark, rows)).collect())
    least = brute.components([brute.simhash(t) for _, t, _ in rows], [i for i, _, _ in rows])
    groups = {}
    for (i, t, _), c in zip(rows, least, strict=True):
        groups.setdefault((c, i == c), set()).add((i, t))
    assert len(kept) == len(set(kept)) and set(kept) <= set().union(*(g for (_, first), g in groups.items() if first))
    assert len(kept) == len(components_of([brute.simhash(t) for _, t, _ in rows]))


def components_of(fps):
    return set(brute.components(fps, list(range(len(fps)))))


@needs_data
def test_suffix_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark).select("doc_id", "text").collect()]
    expected = sorted((i, *x) for (i, _), x in zip(docs, brute.repeated_bytes([t for _, t in docs]), strict=True))
    assert sorted(map(tuple, suffix_dedup.op5_suffix_dedup(spark, D).collect())) == expected


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 1])
def test_repeated_strings_of_made_texts(spark, monkeypatch, crowd):
    """Overlaps, repeats inside a text, runs of one letter, and cuts inside characters; both ways of comparing."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("abcdefgh ß"), 900)) for _ in range(6)]
    texts = [
        noise[0], "q" + noise[0][100:700] + noise[1], noise[2] + noise[2][:450], "a" * 1500, "b" * 400, noise[3][:399], noise[3][:400], noise[4] + "漢" * 300,
        noise[5] + "漢" * 500, "", None, noise[1][300:850] + "x" + noise[0][350:760], ("ab" * 500), noise[0],
    ]
    docs = brute.frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = sorted(map(tuple, suffix_dedup.dedup_strings(docs).collect()))
    assert got == sorted((i, *x) for i, x in enumerate(brute.repeated_bytes(texts)))


def test_long_text_is_parsed_in_pieces(spark, monkeypatch):
    """A passage across the border of two pieces, and copies with no id or a repeated one."""
    rng = np.random.default_rng(5)
    noise = "".join(rng.choice(list("abcdefghij"), suffix_dedup.PIECE + 5000))
    passage = noise[suffix_dedup.PIECE - 300 : suffix_dedup.PIECE + 400]
    docs = brute.frame(spark, [(1, noise, "s"), (2, passage, "s"), (None, "z" + passage[:450], None), (2, passage, "s")])
    got = sorted(((r.doc_id or 0, r.n_removed, r.n_spans) for r in suffix_dedup.dedup_strings(docs).collect()))
    assert got == [(0, 450, 1), (1, 700, 1), (2, 700, 1), (2, 700, 1)]


@needs_data
def test_decontaminate_query(spark):
    assert brute.same_as_sql(decontaminate.op2_decontaminate(spark, D), decontaminate.SQL, D, ["documents", "benchmark"])


def test_short_items_in_long_documents(spark):
    words = [f"w{i}" for i in range(3000)]
    items = [(1, " ".join(words[700:720])), (2, "only three words"), (3, None), (4, ""), (5, " ".join(words[100:130] + ["no"] * 3)), (6, " ".join(words[50:60] + ["other"] * 9)), (7, " ".join(words[::7]))]
    docs = [(10, " ".join(words)), (11, "here are ONLY three\twords of it"), (12, None), (13, ""), (None, " ".join(words[690:725])), (14, "w1 w2")]
    found = decontaminate.find_leaks(brute.frame(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string"), block_bytes=200)
    expected = brute.leaks(docs, items)
    assert {(r.id if r.id < 1 << 62 else None, r.item_id) for r in found.collect()} == expected and expected
    kept = decontaminate.without_leaks(brute.frame(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string"), block_bytes=200)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == sorted((i or 0, t) for i, t in docs if t and i not in {d for d, _ in expected})
    assert {r.doc_id for r in kept.collect() if not r.text} == {12, 13}
    named = spark.createDataFrame([(f"item {i}", t) for i, t in items], "item_id string, text string")  # ids of text, and many blocks
    assert {(r.id if r.id < 1 << 62 else None, r.item_id) for r in decontaminate.find_leaks(brute.frame(spark, [(i, t, "s") for i, t in docs]), named, block_bytes=50).collect()} == {(i, f"item {j}") for i, j in expected}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.without_leaks(brute.frame(spark), empty).count() == len(brute.TEXTS)
    assert decontaminate.without_leaks(brute.frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.find_leaks(brute.frame(spark), empty).count() == 0


def test_items_that_repeat_themselves(spark):
    """One repeated word or phrase, once or scattered in ordinary text, against brute force."""
    rng = np.random.default_rng(11)
    prose = lambda n: [f"p{x}" for x in rng.integers(0, 5000, n)]
    phrases = [[f"r{i}x{j}" for j in range(k)] for i, k in enumerate((1, 1, 2, 7, 20, 20, 33))]
    items = [(i, " ".join((p * 200)[:200])) for i, p in enumerate(phrases)] + [(50, " ".join(prose(40)))]
    docs = [(100 + i, " ".join(prose(400) + (p * 9)[: len(p) + 4] + prose(400))) for i, p in enumerate(phrases)]
    docs += [(200 + i, " ".join(prose(300) + (p * 9)[: max(5, int(0.9 * len(p)) + 4)] + prose(300))) for i, p in enumerate(phrases)] + [(300, items[-1][1]), (301, " ".join(prose(500)))]
    rows, frame = brute.frame(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string")
    expected = brute.leaks(docs, items)
    assert {(r.id, r.item_id) for r in decontaminate.find_leaks(rows, frame).collect()} == expected and len(expected) > 12
    assert {r.doc_id for r in decontaminate.without_leaks(rows, frame).collect()} == {i for i, _ in docs} - {i for i, _ in expected}


@needs_data
def test_fingerprint_query(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in table(spark).select("doc_id", "text").collect()), reverse=True)
    rows = {r.doc_id: r for r in fingerprint.op7_order_minhash(spark, D).collect()}
    assert len(rows) == len(docs)
    seen = {}
    for n, (i, t) in enumerate(docs):
        after, k, r = docs[(n + 1) % len(docs)][1], len(t) // 3, rows[i]
        new = t[: len(t) - k] + after[:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        assert r.edited_fingerprint == fingerprint.as_text(plain_order_minhash(new))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in rows.values() if r.n_chars > 300]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.98


def plain_order_minhash(text):
    """The signature by sorting all numbered k-mers of each bin."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    h, seen, bins = fingerprint.kmers(codes), {}, {}
    base, out = int(fingerprint._B), np.zeros(fingerprint.BINS, np.uint64)
    for place, x in enumerate(h.tolist()):
        n = seen[x] = seen.get(x, -1) + 1
        x = int(fingerprint.mix(np.array([(x + n * base) % (1 << 64)], np.uint64))[0]) if n else x
        bins.setdefault(x >> 59, []).append((x & ((1 << 59) - 1), place, x))
    for b, found in bins.items():
        value = b + 1
        for _, _, x in sorted(sorted(found)[: fingerprint.LEAST], key=lambda y: y[1]):
            value = (value * base + x) % (1 << 64)
        out[b] = int(fingerprint.mix(np.array([value], np.uint64))[0]) >> 32 | 1
    return out


def test_fingerprints_of_awkward_rows(spark):
    rows = sorted(((r.doc_id or 0, r.n_chars, r.fingerprint) for r in fingerprint.edit_report(brute.frame(spark)).collect()))
    assert len(rows) == len(brute.TEXTS)
    prints = {(i, n): f for i, n, f in rows}
    empty = "0" * fingerprint.BINS * fingerprint.DIGITS
    assert prints[0, 0] == prints[1, 0] == prints[2, 0] == empty and prints[3, 27] == prints[4, 27] != empty
    assert fingerprint.edit_report(brute.frame(spark, [])).count() == 0
    alone = fingerprint.edit_report(brute.frame(spark, [(1, "abc def ghi", "s")])).collect()
    assert [(r.near_next, r.n_chars) for r in alone] == [(1.0, 11)]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_id_are_dealt_to_many_parts(spark, doc_id):
    docs = brute.frame(spark, [(doc_id, f"text number {i} of many", None) for i in range(2000)] + [(i, f"another text {i}", None) for i in range(100, 500)])
    sizes = [r["count"] for r in fingerprint.neighbour_parts(docs, 16).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 12 and max(sizes) < 500
    assert fingerprint.edit_report(docs, 16).count() == 2400


def test_repeated_rows_are_dealt_to_many_parts(spark):
    """Equal rows lie in several parts; the report is that of one part but for the order of ties."""
    docs = brute.frame(spark, [(5, "one text that very many rows hold", None)] * 1500 + [(i, f"another text {i} {'word ' * (i % 9)}", None) for i in range(10, 400)] + [(5, f"odd {i}", None) for i in range(50)])
    sizes = [r["count"] for r in fingerprint.neighbour_parts(docs, 16).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 12 and max(sizes) < 500
    assert brute.rows_of(fingerprint.edit_report(docs, 16)) == brute.rows_of(fingerprint.edit_report(docs, 1))


@pytest.mark.parametrize("run", [simhash.near_duplicates, suffix_dedup.dedup_strings, simhash.keep_one])
def test_empty_table(spark, run):
    assert run(brute.frame(spark, [])).count() == 0
