"""Mixes, shards and the corpus pipeline."""

import os
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from locusflow.llm import mixing, sharding
from locusflow.llm.quality import THRESHOLD, learn, score_quality, train_rows
from locusflow.llm.training import labels
from tests.llm import brute

D = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")


@needs_data
def test_mix_query(spark):
    assert brute.same_as_sql(mixing.op8_mix_sources(spark, D), mixing.sql(), D, ["documents"])


def test_targets_refill_by_weight(spark):
    """A small source of great weight stops at three times its size; the others share what it leaves."""
    rows = [("sa", "a", 1000), ("sb", "b", 500), ("sc", "c", 10), ("n", None, 300)]
    got = {r.skey: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "skey string, source string, source_size long")).collect()}
    weight, size = {"sa": 1, "sb": 2, "sc": 3, "n": 1}, {k: s for k, _, s in rows}
    left, open_, expected = sum(size.values()), set(size), {}
    while over := [k for k in open_ if left * weight[k] / sum(weight[x] for x in open_) > 3 * size[k]]:
        expected |= {k: 3.0 * size[k] for k in over}
        open_ -= set(over)
        left = sum(size.values()) - sum(expected.values())
    expected |= {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
    assert got == pytest.approx(expected) and expected["sc"] == 30


def test_mix_of_awkward_rows(spark):
    docs = brute.frame(spark)
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(brute.TEXTS)
    assert sorted(r["size"] for r in rows) == sorted(len(brute.words(t)) for _, t, _ in brute.TEXTS)
    assert all(r.taken <= 3 * r["size"] for r in rows) and all(r.taken % r["size"] == 0 for r in rows if r["size"])
    assert {r.taken for r in rows if r.doc_id == 4} == {next(r.taken for r in rows if r.doc_id == 4)}
    assert brute.rows_of(mixing.mix_sources(docs)) == brute.rows_of(mixing.mix_sources(docs.repartition(3)))
    taken = mixing.take_documents(docs)
    assert taken.columns == docs.columns
    times = Counter((r.doc_id, r["size"]) for r in rows for _ in range(r.times))
    assert Counter((r.doc_id, len(brute.words(r.text))) for r in taken.select("doc_id", "text").collect()) == times
    assert mixing.mix_sources(brute.frame(spark, [])).count() == mixing.take_documents(brute.frame(spark, [])).count() == 0


def test_a_source_of_one_id_meets_its_target(spark):
    """Most rows of a source share an id; they are told by their texts."""
    docs = brute.frame(spark, [(1, f"text {i} of one id", "a") for i in range(3000)] + [(i, f"other text {i} here and so on", "b") for i in range(10, 2500)])
    rows = mixing.mix_sources(docs).collect()
    for source in "ab":
        got = [(r.taken, r.target) for r in rows if r.source == source]
        assert sum(t for t, _ in got) == pytest.approx(got[0][1], abs=8)


def test_larger_budgets_hold_smaller_ones(spark):
    rows = spark.range(5000).select(F.lit("k").alias("skey"), (F.col("id") % 7 + 1).alias("size"), mixing.mix_hash(F.col("id").cast("string")).alias("h"))
    budgets = spark.createDataFrame([("k", i, float(b)) for i, b in enumerate((10, 500, 9000, 19_000))], "skey string, budget_id int, budget double")
    got = {r.budget_id: r.threshold for r in mixing.budget_thresholds(rows, budgets).collect()}
    assert sorted(got.values()) == [got[i] for i in range(4)]
    for i, b in enumerate((10, 500, 9000, 19_000)):
        assert abs(rows.where(F.col("h") < got[i]).agg(F.sum("size")).first()[0] - b) <= 7


@needs_data
def test_shard_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    rows = sharding.op4_shard_slots(spark, D).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, crc32(raw), "bytes", None)
    loads = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(loads) - min(loads) <= max(r["size"] for r in rows)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_of_awkward_rows(spark):
    docs = brute.frame(spark)
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(brute.TEXTS) and len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert sharding.shard_documents(brute.frame(spark, [])).count() == 0
    out = sharding.assign_shards(docs)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == len(brute.TEXTS)


def test_slot_map_versions(spark, tmp_path):
    loads = [(i * 7919) % 101 + 1 for i in range(512)]
    first = sharding.SlotMap.build(loads, 4)
    drifted = [x * 5 if s == 0 else x for x, s in zip(loads, first.shard_of, strict=True)]
    second = first.rebalance(drifted)
    spread = lambda m: max(m.shard_loads(drifted)) - min(m.shard_loads(drifted))
    assert spread(second) <= 0.01 * sum(drifted) / 4 < spread(first)
    third = second.grow(drifted)
    moved = [(a, b) for a, b in zip(second.shard_of, third.shard_of, strict=True) if a != b]
    assert moved and {b for _, b in moved} == {4}
    path = str(tmp_path / "map")
    for m in (first, second, third):
        m.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == third and sharding.SlotMap.load(spark, path, 1) == first


def test_map_is_stored_edited_and_read_again(spark, tmp_path):
    """The second run reads the map of the first, moves slots for the drifted loads only, and stores version 2."""
    path = str(tmp_path / "slots")
    docs = brute.frame(spark, [(i, "x" * (i % 50), "s") for i in range(2000)])
    first = {r.doc_id: r.shard for r in sharding.assign_shards(docs, map_path=path).collect()}
    assert {r.doc_id: r.shard for r in sharding.assign_shards(docs, map_path=path).collect()} == first
    assert sharding.SlotMap.load(spark, path).version == 1
    drifted = brute.frame(spark, [(i, "x" * (i % 50 if first[i] else 400), "s") for i in range(2000)])
    rows = sharding.shard_documents(drifted, map_path=path).collect()
    assert sharding.SlotMap.load(spark, path).version == 2 == rows[0].map_version
    loads = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(loads) - min(loads) < 0.02 * sum(loads)
    one = brute.frame(spark, [(7, f"text {i}", "s") for i in range(4000)])
    assert len({r.vslot for r in sharding.shard_documents(one).collect()}) > 2000  # one id, many slots


@needs_data
def test_pipeline_stage_by_stage(spark):
    """Each stage against brute force over what the one before kept."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    good = stages["quality classifier"](spark, docs, D)
    scored = score_quality(docs, learn(docs, labels(spark, D), train_rows()))
    assert texts(good) == texts(scored.where(f"score >= {THRESHOLD}")) and good.columns == docs.columns
    before = sorted(texts(good).items())
    single = stages["simhash near-dedup"](spark, good, D).cache()
    least = brute.components([brute.simhash(t) for _, t in before], [i for i, _ in before])
    assert texts(single) == {i: t for (i, t), c in zip(before, least, strict=True) if c == i}
    clean = stages["benchmark decontamination"](spark, single, D).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    leaked = {i for i, _ in brute.leaks(texts(single).items(), items)}
    assert texts(clean) == {i: t for i, t in texts(single).items() if i not in leaked}
    mixed = stages["mixing sources to target weights"](spark, clean, D)
    times = {r.doc_id: r.times for r in mixing.mix_sources(clean).collect() if r.times}
    assert Counter(r.doc_id for r in mixed.collect()) == times
    final = stages["sharding"](spark, mixed, D)
    assert final.columns == [*docs.columns, "shard"] or sorted(final.columns) == sorted([*docs.columns, "shard"])
    assert Counter(r.doc_id for r in final.collect()) == times


@needs_data
def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, D).select("doc_id", "text", "shard").collect()
    assert out and {r.shard for r in out} <= set(range(8))


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """The whole run over null, empty, repeated and clashing rows, over an empty table, and against its stages by hand."""
    marks = spark.createDataFrame([(1, 0, 0), (3, 1, 0), (5, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("a", "déjà vu ß 漢字 \U0001f600 one two"), ("b", None), ("c", "")], "item_id string, text string")
    for name, rows in (("some", brute.TEXTS), ("none", [])):
        top = tmp_path / name
        docs = brute.frame(spark, rows).drop("shard")
        for table, df in (("documents", docs), ("labels", marks), ("benchmark", items)):
            df.write.parquet(str(top / f"{table}.parquet"))
        out = corpus_pipeline.run(spark, str(top))
        assert sorted(out.columns) == sorted([*docs.columns, "shard"])
        by_hand = docs
        for _, stage in corpus_pipeline.STAGES:
            by_hand = stage(spark, by_hand, str(top))
        got, expected = (Counter((r.doc_id, r.text) for r in x.select("doc_id", "text").collect()) for x in (out, by_hand))
        assert got == expected and set(got) <= {(i, t) for i, t, _ in rows}
        kept = {t for _, t in got}
        assert brute.TEXTS[-1][1] not in kept and (not rows or kept)


def test_pipeline_of_awkward_rows(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = brute.frame(spark)
    assert score_quality(docs, learn(docs, marks, train_rows())).count() == len(brute.TEXTS)


def test_stored_maps_of_other_sizes(spark, tmp_path):
    """A map that has grown is used with its own shards; one of other slots is refused, not joined in part."""
    docs, path = brute.frame(spark, [(i, f"word {i} " * (i % 9), "s") for i in range(300)]), f"{tmp_path}/map"
    assert len({r.shard for r in sharding.shard_documents(docs, 4, 64, path).collect()}) == 4
    rows = docs.select("doc_id", sharding.size_bytes(F.col("text")).alias("size"), sharding.virtual_slot(F.col("doc_id"), F.col("text"), 64).alias("vslot"))
    sharding.SlotMap.load(spark, path).grow(sharding.slot_loads(rows, 64)[0]).save(spark, path)
    for out in (sharding.shard_documents(docs, 4, 64, path), sharding.assign_shards(docs, 4, 64, path)):
        got = [r.shard for r in out.collect()]
        assert len(got) == 300 and set(got) == set(range(5))
    for call in (sharding.shard_documents, sharding.assign_shards):
        with pytest.raises(ValueError, match="64 slots, not 4096"):
            call(docs, map_path=path)
