"""Reads into fragments: pairs by order of arrival, orphans and single reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.config import CountConfig
from locusflow.functions import flags as fl
from locusflow.functions.cigar import BLOCKS, blocks_length, cigar_blocks
from locusflow.operators.feature_index import MADE, resolve_in_rows, resolver
from locusflow.sources.shared import written

#: Columns that name a fragment: the sample, the hash by which names are dealt out,
#: and the place in the file of its first read. All are whole numbers; the pairing
#: shuffle hashes the first two, so grouping by fragment after it needs no shuffle.
PAIR_KEY = ["sample_idx", "name_hash", "first_ord"]
#: A single read is named by its place alone.
READ_KEY = ["sample_idx", "first_ord"]


def fragment_key(cfg: CountConfig) -> list[str]:
    return PAIR_KEY if cfg.paired else READ_KEY


def with_blocks(reads: DataFrame) -> DataFrame:
    """Add ``reverse`` and, unless the source gives them, the aligned ``blocks``."""
    added = {"reverse": fl.has(F.col("flags"), fl.REVERSE)}
    if "blocks" not in reads.columns:
        added["blocks"] = cigar_blocks(F.col("cigar"), F.col("pos"))
    return reads.withColumns(added)


def named_rows(reads: DataFrame) -> DataFrame:
    """What pairing looks at, and ``row``, what it carries of a read."""
    keep = F.struct("chrom", "blocks", "reverse", "nh", "file_ord", *([] if "dropped" not in reads.columns else ["dropped"]))
    return reads.select("sample_idx", F.xxhash64("qname").alias("name_hash"), "qname", "solo", "file_ord", keep.alias("row"))


def mate_rows(reads: DataFrame) -> DataFrame:
    """Pair surviving reads of one name two by two in file order.

    Rows (1,2), (3,4), ... of a (sample, name) pair up; the later row is the record
    and the earlier its mate; a row without partner is an orphan. Rows marked
    ``solo`` stay single. One shuffle, by sample and the name's hash; no aggregate.
    Names are compared in full: the hash only deals them out and sorts fast.
    """
    dealt = named_rows(reads).repartition("sample_idx", "name_hash")
    return mates_of(dealt)


def mates_of(dealt: DataFrame) -> DataFrame:
    """Mates among ``named_rows`` that are dealt out by sample and name hash."""
    w = Window.partitionBy("name_hash", "sample_idx", "qname", "solo").orderBy("file_ord")
    numbered = dealt.withColumns({"rn": F.row_number().over(w), "after": F.lead("row").over(w)})
    single = F.col("solo")
    first = numbered.where(single | (F.col("rn") % 2 == 1))
    paired = ~single & F.col("after").isNotNull()
    return first.select(
        "sample_idx", "name_hash", F.col("file_ord").alias("first_ord"), "qname",
        F.when(single, "single").when(paired, "pair").otherwise("orphan").alias("kind"),
        F.when(paired, F.col("after")).otherwise(F.col("row")).alias("rec"),
        F.when(paired, F.col("row")).alias("mate"),
    )


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows that stand next to each other under one key; the rest alone, as "left", or "single" if solo.

    Rows come sorted by key and place. Only a row whose partner may still come is kept from one batch to the next.
    """

    def emit(t: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        n = t.num_rows
        solo = t.column("solo").to_numpy()
        same = np.ones(max(0, n - 1), bool)
        for c in ("sample_idx", "name_hash", "qname"):
            x = t.column(c).combine_chunks()
            same &= pc.fill_null(pc.equal(x[1:], x[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(x[1:]).to_numpy(zero_copy_only=False) & pc.is_null(x[:-1]).to_numpy(zero_copy_only=False))
        same &= ~solo[1:] & ~solo[:-1]
        starts = np.concatenate(([True], ~same)) if n else np.zeros(0, bool)
        at = np.arange(n)
        begun = np.maximum.accumulate(np.where(starts, at, 0))
        first = (at - begun) % 2 == 0
        paired = first & np.append(same, False) if n else first
        held = n > 0 and not last and first[-1] and not solo[-1]
        mine = np.flatnonzero(first if not held else first & (at < n - 1))
        rec = pa.array(np.where(paired[mine], mine + 1, mine))
        mate = pa.array(mine, mask=~paired[mine])
        rows, names = t.column("row").combine_chunks(), ["sample_idx", "name_hash", "qname"]
        kind = pa.array(np.where(paired[mine], "pair", np.where(solo[mine], "single", "left")), pa.string())
        taken = t.take(pa.array(mine))
        out = [*(taken.column(c).combine_chunks() for c in names), taken.column("file_ord").combine_chunks(), kind, rows.take(rec), rows.take(mate)]
        return pa.RecordBatch.from_arrays(out, names=[*names, "first_ord", "kind", "rec", "mate"]), t.slice(n - 1 if held else n)

    kept = None
    for b in batches:
        t = pa.Table.from_batches([b])
        got, kept = emit(pa.concat_tables([kept, t]) if kept is not None and kept.num_rows else t, False)
        yield got
    if kept is not None and kept.num_rows:
        yield emit(kept, True)[0]


def sorted_splits(reads: DataFrame) -> DataFrame:
    """``named_rows`` with reads of one name side by side in each partition; Spark sorts, and so spills, and moves no row to another one."""
    return named_rows(reads).sortWithinPartitions("sample_idx", "name_hash", "qname", "solo", "file_ord")


def mates_type(rows: DataFrame) -> str:
    row = rows.schema["row"].dataType.simpleString()
    return f"sample_idx int, name_hash bigint, qname string, first_ord bigint, kind string, rec {row}, mate {row}"


def adjacent_mates(reads: DataFrame) -> DataFrame:
    """Reads paired within their partition, as ``mate_rows`` has them, but for rows without partner there, whose kind is "left"."""
    rows = sorted_splits(reads)
    return rows.mapInArrow(_adjacent, mates_type(rows))


def _joined_blocks(rec: pa.Array, mate: pa.Array, near: np.ndarray) -> pa.ListArray:
    """Each record's blocks, followed by its mate's where ``near`` says so."""
    own, other = (pc.list_parent_indices(x).to_numpy().astype(np.int64) for x in (rec, mate))
    keep = near[other]
    owner = np.concatenate((own, other[keep]))
    pairs = pa.concat_arrays([pc.list_flatten(rec), pc.list_flatten(mate).filter(pa.array(keep))])
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(rec)))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs.take(pa.array(np.argsort(owner, kind="stable"))))


def fragment_batch(mates: pa.RecordBatch) -> pa.RecordBatch:
    """``pair_fragments`` of a batch, with ``left``: what a row that waits for its mate keeps; such a row has no blocks here."""
    rec, mate = mates.column("rec"), mates.column("mate")
    part = lambda x, c: pc.struct_field(x, c)
    waits = pc.equal(mates.column("kind"), "left")
    there, paired = pc.invert(waits), pc.is_valid(mate).to_numpy(zero_copy_only=False)
    near = paired & pc.fill_null(pc.equal(part(mate, "chrom"), part(rec, "chrom")), False).to_numpy(zero_copy_only=False)
    blocks, other = pc.if_else(there, part(rec, "blocks"), pa.scalar(None, part(rec, "blocks").type)), part(mate, "blocks")
    pairs, count = pc.list_flatten(blocks), len(rec)
    size = pc.add(pc.subtract(part(pairs, "end"), part(pairs, "start")), 1).to_numpy()
    read_len = np.bincount(pc.list_parent_indices(blocks).to_numpy(), size, count).astype(np.int64)
    left = pa.StructArray.from_arrays([mates.column("qname"), mates.column("first_ord"), rec], names=["qname", "first_ord", "rec"], mask=there)
    made = {
        "sample_idx": mates.column("sample_idx"), "name_hash": mates.column("name_hash"), "first_ord": mates.column("first_ord"), "last_ord": part(rec, "file_ord"), "qname": mates.column("qname"), "kind": mates.column("kind"),
        "chrom": part(rec, "chrom"), "query_blocks": _joined_blocks(blocks, other, near), "all_blocks": _joined_blocks(blocks, other, paired), "read_len": pa.array(read_len),
        "reverse": part(rec, "reverse"), "mate_reverse": part(mate, "reverse"), "nh": pc.max_element_wise(part(rec, "nh"), pc.fill_null(part(mate, "nh"), 1)), "left": left,
    }
    if "dropped" in [f.name for f in rec.type]:
        made["dropped"] = part(rec, "dropped")
    return pa.RecordBatch.from_arrays(list(made.values()), names=list(made))


def pair_in_splits(reads: DataFrame, first: Callable[[DataFrame], DataFrame], later: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What is wanted of all mates of ``reads``, of which only those are shuffled that splits cannot pair by themselves.

    A name whose reads come in even numbers in each split pairs there as it does in the
    whole file, as pairs are counted off in file order. So each split pairs what it has; what
    is left over, one read of a name at most, is dealt out afterwards and paired there. A name
    that is left over in one split and was paired in another one is paired anew from all its
    reads: its pairs there do not count, and its reads are read once more. Only names of three
    and more reads can be such.

    ``first`` makes of ``sorted_splits`` what is wanted of each row as ``_adjacent`` has
    them, with sample_idx, name_hash, first_ord and last_ord, the places of its reads, whether
    ``paired``, and for those left over ``left`` with qname, first_ord and rec. It is written to
    a shared folder, so the reads are gone through once, but for the names named above.
    ``later`` makes the same of ``mate_rows``.

    Splits must be ranges of the file, as those of files are. Where reads of a sample come
    otherwise, which the places tell, all are dealt out by name instead.
    """
    key = ["sample_idx", "name_hash"]
    table = written(first(sorted_splits(reads)).withColumn("split", F.spark_partition_id()))
    ranges = table.groupBy("sample_idx", "split").agg(F.min("first_ord").alias("lo"), F.max("last_ord").alias("hi"))
    before = F.max("hi").over(Window.partitionBy("sample_idx").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    if not ranges.withColumn("before", before).where("before >= lo").isEmpty():
        return later(mate_rows(reads))
    done, rest = table.where("left IS NULL").drop("left", "split", "last_ord"), table.where("left IS NOT NULL").select(*key, "left.*")
    torn = written(done.where("paired").select(*key).join(rest.select(*key).distinct(), key, "left_semi").distinct())
    alone = rest.select(*key, "qname", F.lit(False).alias("solo"), F.col("first_ord").alias("file_ord"), F.col("rec").alias("row"))
    if not torn.isEmpty():
        done = done.join(torn.withColumn("paired", F.lit(True)), [*key, "paired"], "left_anti")
        again = named_rows(reads.where("NOT solo")).join(torn, key, "left_semi")
        alone = alone.join(torn, key, "left_anti").unionByName(again)
    return done.drop("paired").unionByName(later(mates_of(alone.repartition(*key))))


def mates_in_splits(reads: DataFrame) -> DataFrame:
    """The rows of ``mate_rows``, paired in splits."""
    left = "CASE WHEN kind = 'left' THEN struct(qname, first_ord, rec) END AS left"
    first = lambda rows: rows.mapInArrow(_adjacent, mates_type(rows)).selectExpr("*", "rec.file_ord AS last_ord", "kind = 'pair' AS paired", left)
    return pair_in_splits(reads, first, lambda mates: mates)


def resolve_in_splits(reads: DataFrame, index, cfg: CountConfig, keep: list[str]) -> DataFrame:
    """``resolve`` of all fragments of ``reads``: each split pairs and resolves what it can, and hands on only outcomes and what is left over."""
    marked = ["filtered"] if "dropped" in reads.columns else []
    own = [*dict.fromkeys(["sample_idx", "name_hash", "first_ord", *keep])]
    out = [*own, "nh", "status", "targets", *marked]

    all_columns = [*out, "last_ord", "paired", "left"]

    def first(rows: DataFrame) -> DataFrame:
        row, work = rows.schema["row"].dataType.simpleString(), resolver(index, cfg, True, all_columns)
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | MADE | {"first_ord": "bigint", "last_ord": "bigint", "nh": "int", "left": f"struct<qname:string,first_ord:bigint,rec:{row}>"}
        return rows.mapInArrow(lambda batches: work(fragment_batch(b) for b in _adjacent(batches) if b.num_rows), ", ".join(f"`{c}` {kinds[c]}" for c in all_columns))

    def later(mates: DataFrame) -> DataFrame:
        return resolve_in_rows(pair_fragments(mates), index, cfg, True, own).select(*out)

    return pair_in_splits(reads, first, later)


def candidates(classified: DataFrame, dropped: bool) -> DataFrame:
    """Reads that passed the filters, with their blocks; with ``dropped`` the others too, each alone, without blocks and with its status in that column."""
    if not dropped:
        return with_blocks(classified.where(F.col("status").isNull()))
    gone, none = F.col("status").isNotNull(), F.expr(f"cast(array() as {BLOCKS})")
    return with_blocks(classified).withColumns({"dropped": F.col("status"), "solo": F.col("solo") | gone, "blocks": F.when(gone, none).otherwise(F.col("blocks"))})


def fragments(classified: DataFrame, cfg: CountConfig, dropped: bool = False) -> DataFrame:
    """Fragments of the reads that passed the filters.

    Columns: the fragment's key, qname, kind, chrom, query_blocks (looked up in the
    annotation), all_blocks (whose overlap counts), read_len, reverse,
    mate_reverse, nh. ``read_len`` is the record's alone, and a mate on another
    contig adds to all_blocks only. With ``dropped`` the reads that a filter took
    come along, each alone and without blocks, and a column of that name has their status.
    """
    more, reads = ["dropped"] if dropped else [], candidates(classified, dropped)
    if not cfg.paired:
        return reads.select(
            "sample_idx", F.col("file_ord").cast("bigint").alias("first_ord"), "qname", F.lit("single").alias("kind"), "chrom",
            F.col("blocks").alias("query_blocks"), F.col("blocks").alias("all_blocks"), blocks_length(F.col("blocks")).alias("read_len"),
            "reverse", F.lit(None).cast("boolean").alias("mate_reverse"), "nh", *more,
        )
    return pair_fragments(mate_rows(reads))


def pair_fragments(mates: DataFrame) -> DataFrame:
    """Fragments of rows as ``mate_rows`` has them."""
    none = f"cast(array() as {BLOCKS})"
    near = f"CASE WHEN mate.chrom = rec.chrom THEN mate.blocks ELSE {none} END"
    dropped = "dropped" in mates.schema["rec"].dataType.names
    return mates.selectExpr(
        *PAIR_KEY, "qname", "kind", "rec.chrom AS chrom",
        f"CASE WHEN mate IS NULL THEN rec.blocks ELSE concat(rec.blocks, {near}) END AS query_blocks",
        "CASE WHEN mate IS NULL THEN rec.blocks ELSE concat(rec.blocks, mate.blocks) END AS all_blocks",
        "aggregate(rec.blocks, 0L, (a, b) -> a + b.end - b.start + 1) AS read_len", "rec.reverse AS reverse", "mate.reverse AS mate_reverse",
        "greatest(rec.nh, coalesce(mate.nh, 1)) AS nh", *(["rec.dropped AS dropped"] if dropped else []),
    )
