"""A run's state: the summaries of its batches, kept and merged.

A state is a folder with one policy-free summary (:mod:`tierwise.operators.summary`)
for each batch of records. Adding a batch reads that batch only; results over all
batches come from the small merged summary, so history is never read again, and
another policy, rule or method needs no new state. A batch that is put again under
its name (a retried job) replaces its former rows, so nothing is counted twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.summary import N_RECORDS, merge_summaries, prepare_counts, summarise
from ..plans.runs import prepare, resolve
from ..plans.spec import ColumnSpec, Rule, TierPolicy
from .io import save

_BATCH = "tw_batch"


class SummaryState:
    """The summaries at ``path`` (any folder that Spark reads and writes), by batch."""

    def __init__(self, spark: SparkSession, path: str, spec: ColumnSpec):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec

    def put(self, records: DataFrame, batch: str) -> None:
        """Adds a batch of records, or replaces it. One batch has one writer at a time."""
        self.put_summary(summarise(records, self.spec), batch)

    def put_summary(self, summary: DataFrame, batch: str) -> None:
        if not re.fullmatch(r"[0-9A-Za-z_.-]+", batch):
            raise ValueError(f"batch name {batch!r} may hold letters, digits, '_', '.' and '-' only")
        save(summary, f"{self.path}/{_BATCH}={batch}")

    def batches(self) -> list[str]:
        """The names of the batches (one small row for each)."""
        rows = self.spark.read.parquet(self.path).select(_BATCH).distinct().collect()
        return sorted(str(r[0]) for r in rows)

    def summary(self) -> DataFrame:
        """The summary of the records of all batches."""
        return merge_summaries(self.spark.read.parquet(self.path).drop(_BATCH), spec=self.spec)

    def resolve(self, policy: TierPolicy, rule: Rule | str, *, clean: bool = True, **names) -> DataFrame:
        """One row per entity: ``entity, modal, latest``, over the records of all batches."""
        rows = prepare(self.summary(), self.spec) if clean else self.summary()
        return resolve(rows, self.spec, policy, rule, clean=False, no_null_entity=clean, weight=N_RECORDS, **names)

    def counts(self) -> DataFrame:
        """One row: n_records, n_removed, n_sentinel (see :func:`tierwise.operators.summary.prepare_counts`)."""
        return prepare_counts(self.summary(), self.spec)

    def compacted(self, path: str, batch: str) -> SummaryState:
        """A new state at ``path`` that holds all of this one as one batch. The old one stays
        as it is, so a failure on the way loses nothing and counts nothing twice."""
        out = SummaryState(self.spark, path, self.spec)
        out.put_summary(self.summary(), batch)
        return out
