"""The whole counting plan: alignments and annotation in, counts and statuses out."""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.config import CountConfig
from locusflow.operators.classify import classify
from locusflow.operators.counts import count_status, count_targets
from locusflow.operators.feature_index import collect_features
from locusflow.operators.pairing import candidates, fragments, resolve_in_splits
from locusflow.operators.resolve import resolve


class CountResult:
    """Lazy tables, each planned when it is asked for, and each one pass over the reads but for ``status`` of pairs.

    ``counts`` passes only what hits a feature. Reads that a filter took are never shuffled for ``status``. ``resolved`` has each fragment with
    its status, and each read that a filter took, marked ``filtered``.
    """

    def __init__(self, reads: DataFrame, features: DataFrame, cfg: CountConfig):
        self.reads, self.features, self.cfg = reads, features, cfg

    @cached_property
    def index(self):
        """The features' arrays, sent to all executors once; None where there are too many for that."""
        found = collect_features(self.features, self.cfg)
        return found and self.features.sparkSession.sparkContext.broadcast(found)

    def _resolve(self, frags: DataFrame, unhit: bool = True, keep: list[str] | None = None) -> DataFrame:
        return resolve(frags, self.features, self.cfg, unhit, self.index, keep)

    @cached_property
    def counts(self) -> DataFrame:
        return count_targets(self._resolve(fragments(self.reads, self.cfg).drop("qname"), False, ["sample_idx"]), self.cfg)

    @cached_property
    def status(self) -> DataFrame:
        if self.cfg.paired:  # what a filter took is counted where it is read, by the few columns that filters look at
            taken = count_status(self.reads.where("status IS NOT NULL"))
            rest = count_status(self._resolve(fragments(self.reads, self.cfg).drop("qname"), keep=["sample_idx"]))
            return taken.unionByName(rest).groupBy("sample_idx", "status").agg(F.sum("n").alias("n"))
        return count_status(self._resolve(fragments(self.reads, self.cfg, dropped=True).drop("qname"), keep=["sample_idx"]))

    @cached_property
    def resolved(self) -> DataFrame:
        return self._resolve(fragments(self.reads, self.cfg, dropped=True))


def count_reads(alignments: DataFrame, features: DataFrame, chroms: DataFrame, cfg: CountConfig) -> CountResult:
    """Lazy plan for any number of samples at once; ``sample_idx`` tells them apart."""
    return CountResult(classify(alignments, chroms, cfg), features, cfg)


class KeptResult(CountResult):
    """As ``CountResult``, where all tables are wanted: the reads are gone through once and their outcomes kept.

    Outcomes are a few numbers per read. Those of pairs are written to a shared folder,
    as splits pair what they can by themselves; others are held in memory and on the executors' disks.
    """

    def __init__(self, reads: DataFrame, features: DataFrame, cfg: CountConfig, details: bool):
        super().__init__(reads, features, cfg)
        if cfg.paired and self.index:
            self.resolved = resolve_in_splits(candidates(reads, True), self.index, cfg, ["qname"] if details else [])
        else:
            self.resolved = self._resolve(fragments(reads, cfg, dropped=True).drop(*([] if details else ["qname"]))).persist(StorageLevel.MEMORY_AND_DISK)
        self.counts, self.status = count_targets(self.resolved, cfg), count_status(self.resolved)


def count_once(alignments: DataFrame, features: DataFrame, chroms: DataFrame, cfg: CountConfig, details: bool = False) -> KeptResult:
    return KeptResult(classify(alignments, chroms, cfg), features, cfg, details)
