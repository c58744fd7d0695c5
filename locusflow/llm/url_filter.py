"""URL verdicts: listed rules first, then mined association rules.

Spark's FP-growth mines combinations of URL tokens that go with the label of bad
pages. Rules below the support or confidence asked for, and rules that a shorter
one makes needless, go. A rule is filed under its rarest tokens, so a URL meets
only rules filed under one of its own tokens and then must have all of theirs.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.common import cut
from locusflow.llm.training import labels

BAD = "label=bad"
#: Least number of bad labelled pages that a rule must cover, least confidence, and how many times rarer clean pages must be under it than among all.
LEAST_PAGES, CONFIDENCE, LEAST_GAIN = 8, 0.9, 2.0
# Listed rules as (verdict, host, path).
LISTED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Words in a host that mark a page as bad for the miner.
SEEDS = ("ads", "bets", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_of(url: Column) -> Column:
    """From after the first :// to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 2)


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels with the last two joined too, path segments with digits as #, query keys."""
    host, path = host_of(url), path_of(url)
    parts = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    tag = lambda p, a: F.transform(a, lambda x: F.concat(F.lit(p), x))
    both = F.array(F.concat(F.lit("d:"), F.substring_index(host, ".", -2)))
    return F.array_distinct(F.concat(
        F.array(F.concat(F.lit("s:"), F.lower(F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))), tag("h:", parts), both,
        tag("p:", F.transform(segments, lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "#"))), tag("q:", keys),
    ))


def mine_rules(labelled: DataFrame, least_pages: int = LEAST_PAGES, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule, tokens, lists, size, anchor, confidence) from rows (url, bad); none if no row is bad, or all are.

    A rule goes if the same rule without one of its tokens is at least as confident; of
    rules that tie, the one whose name sorts first is what a URL that fits several is given.
    Hence a token of bad pages alone is in no longer rule, and tokens of just the
    same pages not in one rule: patterns are mined without the former, and with one
    of the latter, its class. A rule asks for a token of each of its ``lists``, which are
    classes or single tokens, so it is one rule however large they are; one of a single list is
    a rule for each token. It is filed under each token of its rarest list (``anchor``).
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule string, tokens array<string>, lists array<array<string>>, size int, anchor string, confidence double")
    items = labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull())
    pages = cut(items.select(F.monotonically_increasing_id().alias("row"), url_tokens(F.col("url")).alias("own"), "bad"))
    n, n_bad = pages.agg(F.count("*"), F.count_if("bad")).first()
    if n_bad in (0, n):
        return empty
    each = pages.select("row", "bad", F.explode("own").alias("token"))
    same = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"h{k}") for k in (1, 2)]  # tells the set of pages by 128 bits
    counts = cut(each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), *same))
    able = counts.where(F.col("n_bad") >= least_pages)
    found = able.where("n_bad = n").select(F.array("token").alias("tokens"), F.lit(1.0).alias("confidence"))
    classes = cut(able.where("n_bad < n").groupBy("n", "n_bad", "h1", "h2").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.col("members")[0].alias("token"), "members"))
    held = each.join(classes.select("token"), "token").groupBy("row", "bad").agg(F.collect_list("token").alias("own"))
    baskets = cut(held.select(F.concat("own", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.expr("cast(array() as array<string>)"))).alias("items")))
    m = baskets.count()
    if m >= least_pages:
        model = FPGrowth(itemsCol="items", minSupport=(least_pages - 0.5) / m, minConfidence=confidence).fit(baskets)
        gain = (1 - F.col("confidence")) * LEAST_GAIN <= 1 - n_bad / n
        found = found.unionByName(model.associationRules.where((F.col("consequent")[0] == BAD) & gain).select(F.array_sort("antecedent").alias("tokens"), "confidence"))
    found = cut(found.withColumn("rule", F.array_join("tokens", " & ")))
    shorter = found.where(F.size("tokens") > 1).select("rule", "confidence", F.explode(F.transform("tokens", lambda t: F.array_join(F.array_remove("tokens", t), " & "))).alias("part"))
    needless = shorter.join(found.select(F.col("rule").alias("part"), F.col("confidence").alias("c")), "part").where("c >= confidence").select("rule").distinct()
    kept = found.join(needless, "rule", "left_anti")
    choices = kept.select("rule", "confidence", F.explode("tokens").alias("token")).join(classes, "token", "left").groupBy("rule", "confidence").agg(F.array_sort(F.collect_list(F.coalesce("members", F.array("token")))).alias("lists"))
    alone = choices.where(F.size("lists") == 1).select("confidence", F.explode(F.col("lists")[0]).alias("rule")).select("rule", "confidence", F.array(F.array("rule")).alias("lists"))
    whole = alone.unionByName(choices.where(F.size("lists") > 1))
    often = counts.select(F.col("token").alias("first"), F.col("n").alias("count"))
    rarest = whole.select("rule", F.explode("lists").alias("any")).withColumn("first", F.col("any")[0]).join(often, "first").groupBy("rule").agg(F.min(F.struct("count", "any"))["any"].alias("any"))
    filed = whole.join(rarest, "rule").select("*", F.explode("any").alias("anchor"))
    return cut(filed.select("rule", F.transform("lists", lambda x: x[0]).alias("tokens"), "lists", F.size("lists").alias("size"), "anchor", "confidence"))


def listed_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host, path, rule, listed): the longest rule (verdict, host, path) that fits each distinct url.

    Every suffix of the host looks its rules up, so the list may be long. At one
    length the rule that sorts first decides.
    """
    base = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    looked = base.select("url", "path", suffix.alias("rule_host"))
    known = rules.select(F.col("verdict"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    fits = looked.join(known, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    best = fits.groupBy("url").agg(F.min(F.struct((-F.length(text)).alias("n"), text.alias("rule"), "verdict")).alias("m"))
    return base.join(best, "url", "left").select("url", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("listed"))


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined): the most confident mined rule of whose lists a url has a token each."""
    tokens = urls.select("url", url_tokens(F.col("url")).alias("own"))
    looked = tokens.select("url", "own", F.explode("own").alias("anchor")).join(rules, "anchor")
    hits = looked.where(F.forall("lists", lambda x: F.arrays_overlap(x, F.col("own"))))
    return hits.groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "rule"))["rule"].alias("mined"))


def judge_urls(pages: DataFrame, listed: DataFrame, mined: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, ...) as page_id, host, path, rule, verdict, mined.

    Work is per distinct url, so a url's repeats cost one look-up. Null urls and
    such without :// have empty host and path and no rule, hence are allowed.
    """
    urls = cut(pages.select("url").where(F.col("url").isNotNull()).distinct())
    verdicts = listed_verdicts(urls, listed).join(matched_rules(urls, mined), "url", "left")
    # Rows without url have nothing to look up, and as one key they would load one task.
    out = pages.select("page_id", "url").where("url is not null").join(verdicts, "url", "left")
    out = out.unionByName(pages.select("page_id", "url").where("url is null"), allowMissingColumns=True)
    verdict = F.coalesce("listed", F.when(F.col("mined").isNotNull(), "block"), F.lit("allow"))
    return out.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", verdict.alias("verdict"), "mined")


def seeded(url: Column, seeds=SEEDS) -> Column:
    """Whether a word of the host is one of ``seeds``."""
    return F.arrays_overlap(F.split(host_of(url), "[^a-z0-9]+"), F.array(*map(F.lit, seeds)))


def labelled_urls(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """(url, bad) to mine from: pages with a quality label of their id, and pages whose host has a seed word, which are bad.

    A page with two labels is bad if either is. Null ids have no label.
    """
    known = marks.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("low"))
    seed = seeded(F.col("url"))
    return pages.join(known, "page_id", "left").where(seed | F.col("low").isNotNull()).select("url", (seed | F.coalesce("low", F.lit(False))).alias("bad"))


def contrasted(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """``labelled_urls``; if no page of it is clean, with the pages that have neither label nor seed word as clean ones."""
    labelled = labelled_urls(pages, marks)
    if labelled.where("not bad").limit(1).count():
        return labelled
    known = marks.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("page_id"))
    rest = pages.join(known, "page_id", "left_anti").where(F.col("url").isNotNull() & ~seeded(F.col("url")))
    return labelled.unionByName(rest.select("url", F.lit(False).alias("bad")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages: the listed rules', else block where a mined rule fits."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = spark.createDataFrame(list(LISTED), "verdict string, host string, path string")
    return judge_urls(pages, listed, mine_rules(contrasted(pages, labels(spark, sf_dir))))
