"""What several operators share: the shared folder, row ids, word splitting and hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
#: Lower-cases A-Z and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Ids of rows without one start here; real ids lie below.
NO_ID = 1 << 62


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local run gets a temporary folder and a cluster an error:
    a machine's own folder would lose results there.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="checkpoints-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    It cuts the lineage, so a lost executor costs no work from before, and tells
    Spark the true size, by which joins choose to broadcast or to shuffle.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of ``cut`` that each open ``scratch`` block has to remove.
_scratch: list[list[str]] = []


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _place(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    system, where = _place(spark, path)
    system.delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``cut`` writes inside the block go at its end; what is read from them must be written by then."""
    own: list[str] = []
    _scratch.append(own)
    try:
        yield
    finally:
        _scratch.remove(own)
        for path in own:
            remove(spark, path)


def row_id(doc_id: Column, text: Column) -> Column:
    """``doc_id``, or for rows without one a number above all real ids, told by the text."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(1 << 61)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8; null has none."""
    return text.encode("utf-8", "replace").translate(LOWER).split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


def texts(batch, name: str = "text"):
    """The batch's texts as Python strings, one at a time."""
    for x in batch.column(name):
        yield x.as_py()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bits a key of the filter of ``split_by_keys``, and its least and most bits: 2^26 bits are 8 MB.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 12, 1 << 16, 1 << 26


def split_by_keys(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of ``keys``, rows that surely have none).

    A bitmap of a size in proportion to the number of keys, 8 MB at most, is
    broadcast, so rows that a later join would not touch need not be shuffled. Beyond
    some ten million keys the bitmap fills and more rows are held for the join.
    """
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * n).bit_length()))
    at = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits))
    word, bit = F.floor(at / F.lit(64)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))
    table = cut(keys.select(word.alias("__word"), bit.alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits")))
    held = rows.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(table), "__word", "left")  # 2^20 words at most
    may = F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")) != 0, F.lit(False))
    return tuple(held.where(c).drop("__word", "__bit", "__bits") for c in (may, ~may))


def may_hold(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (id, ...) whose id may be among ``ids`` (id): all that are, and a few others."""
    return split_by_keys(rows, ids, "id")[0]
