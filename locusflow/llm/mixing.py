"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash; a source keeps the documents whose hash lies below its
threshold. Thresholds come from histograms of tokens by source and hash bucket: a
running sum finds the bucket in which the budget falls, and only that bucket is
split further. Nothing is sorted by hash, and a smaller budget's documents are a
subset of a larger one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.llm.common import WORD, cut, documents, word_count

#: Hex digits of the hash per level of refinement, and levels: 3 * 3 digits are 36 bits.
DIGITS, LEVELS = 3, 3
SPAN = 16**DIGITS
#: No document is taken more often than this.
MOST = 3


def mix_hash(key: Column) -> Column:
    """A number of 36 bits that depends on the key alone, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(key), 1, DIGITS * LEVELS), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources (skey, source, source_size): weights 1, 2, 3 repeating in code-point order, null last.

    A target stops at three times its source's size and the excess goes to the
    others by weight. In the order of size per weight the stopped sources come
    first: a source is stopped if its share of what the ones before it leave
    exceeds its stop. One row per source, so the global windows are short.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", ((F.row_number().over(w) - 1) % 3 + 1).cast("bigint"))
    every = Window.partitionBy()
    before = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "skey").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    s = s.withColumns({"all_size": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every), "cap": F.lit(MOST) * F.col("source_size")})
    s = s.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), zero), "weight_before": F.coalesce(F.sum("weight").over(before), zero)})
    left, share = F.col("all_size") - F.col("cap_before"), F.col("all_weight") - F.col("weight_before")
    s = s.withColumn("stopped", F.col("cap") * share < left * F.col("weight"))
    out = lambda c: F.coalesce(F.sum(F.when(F.col("stopped"), F.col(c))).over(every), zero)
    free = (F.col("all_size") - out("cap")) * F.col("weight") / F.nullif(F.col("all_weight") - out("weight"), zero)
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(free)
    return s.select("skey", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def budget_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Hash thresholds for budgets (skey, budget_id, budget) over ``rows`` (skey, size, h).

    Per budget: the documents with h below ``threshold`` hold nearly ``budget``
    tokens, off by at most half of one cell of 2^-36 of the hash range, which is a
    single document but for repeated rows. Any number of budgets a source.
    """
    open_ = budgets.select("skey", "budget_id", "budget", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("base"))
    for level in range(LEVELS):
        unit = SPAN ** (LEVELS - 1 - level)
        cell = F.floor(F.col("h") / F.lit(unit)).cast("bigint")
        part = rows if level == 0 else rows.withColumn("prefix", F.floor(F.col("h") / F.lit(unit * SPAN)).cast("bigint")).join(open_.select("skey", "prefix").distinct(), ["skey", "prefix"], "left_semi")
        hist = part.groupBy("skey", cell.alias("cell")).agg(F.sum("size").alias("tokens"))
        run = F.sum("tokens").over(Window.partitionBy("skey", F.floor(F.col("cell") / F.lit(SPAN))).orderBy("cell"))
        hist = hist.withColumns({"upto": run, "prefix": F.floor(F.col("cell") / F.lit(SPAN)).cast("bigint")})
        hit = open_.drop("tokens").join(hist, ["skey", "prefix"]).where((F.col("base") + F.col("upto") >= F.col("budget")) & (F.col("base") + F.col("upto") - F.col("tokens") < F.col("budget")))
        found = hit.groupBy("skey", "budget_id").agg(F.min(F.struct("cell", "budget", (F.col("base") + F.col("upto") - F.col("tokens")).alias("base"), "tokens")).alias("m"))
        open_ = cut(found.select("skey", "budget_id", F.col("m.budget").alias("budget"), F.col("m.cell").alias("prefix"), F.col("m.base").alias("base"), F.col("m.tokens").alias("tokens")))
    nearer = F.col("base") + F.col("tokens") - F.col("budget") < F.col("budget") - F.col("base")
    return open_.select("skey", "budget_id", (F.col("prefix") + nearer.cast("bigint")).alias("threshold"))


def mix_columns() -> dict[str, Column]:
    """What the mix reads of a document: skey, its source's key; size in words; h, the hash of its id and text."""
    key = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    return {"skey": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "size": word_count(F.col("text")), "h": mix_hash(key)}


def mix_plan(rows: DataFrame) -> DataFrame:
    """(skey, source_size, target, whole, threshold) from rows (source, skey, size, h): one row per source.

    A source below its target is taken ``whole`` times as a whole, and once more
    where the hash lies below ``threshold``.
    """
    sizes = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    targets = cut(source_targets(sizes).withColumn("whole", whole))
    budgets = targets.select("skey", F.lit(0).alias("budget_id"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")).where("budget > 0")
    return cut(targets.join(budget_thresholds(rows, budgets).select("skey", "threshold"), "skey", "left"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and taken, the words that the mix takes.

    Null texts have size 0, a null doc_id is like an empty one. Rows are told by id and
    text, so rows of one id with different texts are taken each by itself, repeated rows
    alike; an empty table gives an empty result, further columns are ignored.
    """
    rows = cut(docs.select("doc_id", "source", *(c.alias(n) for n, c in mix_columns().items())))
    times = F.col("whole") + F.coalesce((F.col("h") < F.col("threshold")).cast("bigint"), F.lit(0))
    return rows.join(mix_plan(rows), "skey").select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def take_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it.

    Only the plan, one row per source, is joined to the texts, which stay where they are.
    Nulls, repeated rows and empty tables are as in ``mix_sources``; empty texts have no
    words and are taken as often as their source is; all columns are kept, whatever their names.
    """
    columns = mix_columns()
    plan = mix_plan(cut(docs.select("source", *(c.alias(n) for n, c in columns.items()))))
    plan = plan.select(F.col("skey").alias("__skey"), F.struct("whole", "threshold").alias("__plan"))
    joined = docs.withColumns({"__skey": columns["skey"], "__h": columns["h"]}).join(plan, "__skey")
    times = F.col("__plan.whole") + F.coalesce((F.col("__h") < F.col("__plan.threshold")).cast("int"), F.lit(0))
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def sql(docs: str = "documents") -> str:
    """The mix in DuckDB: the same thresholds found by sorting."""
    return f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text,''), '{WORD}')) AS BIGINT) AS size,
  CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ' ', coalesce(text, ''))), 1, {DIGITS * LEVELS})) AS BIGINT) AS h FROM {docs}),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, {MOST} * source_size AS cap FROM s0),
s2 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS a, CAST(sum(w) OVER () AS BIGINT) AS aw, CAST(coalesce(sum(cap) OVER o, 0) AS BIGINT) AS cb, CAST(coalesce(sum(w) OVER o, 0) AS BIGINT) AS wb
  FROM s1 WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap * (aw - wb) < (a - cb) * w AS stopped FROM s2),
s4 AS (SELECT *, CAST(coalesce(sum(cap) FILTER (stopped) OVER (), 0) AS BIGINT) AS cs, CAST(coalesce(sum(w) FILTER (stopped) OVER (), 0) AS BIGINT) AS ws FROM s3),
t AS (SELECT source, source_size, coalesce(CASE WHEN stopped THEN CAST(cap AS DOUBLE) ELSE ((a - cs) * w) / nullif(aw - ws, 0) END, 0) AS target FROM s4),
t2 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS k FROM t),
c AS (SELECT source, h, sum(size) AS tokens FROM d GROUP BY source, h),
r AS (SELECT c.source, c.h, c.tokens, sum(c.tokens) OVER (PARTITION BY c.source ORDER BY c.h) AS upto, t2.target - t2.k * t2.source_size AS budget FROM c JOIN t2 ON c.source IS NOT DISTINCT FROM t2.source),
b AS (SELECT source, min(h + CASE WHEN upto - budget < budget - (upto - tokens) THEN 1 ELSE 0 END) AS threshold FROM r WHERE budget > 0 AND upto >= budget AND upto - tokens < budget GROUP BY source)
SELECT d.doc_id, d.size, t2.source_size, t2.target, CAST(d.size * (t2.k + CASE WHEN d.h < b.threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source"""
