"""tierwise: settle one category per entity from long, dated, conflicting records.

Two methods, each with or without re-allocation of low-quality codes:

* modal  - the most frequent code (``modal_by_entity``, ``attach_modal``)
* latest - the most recent code, with a source-priority or code-present-flag
  rule for same-day conflicts (``latest_by_entity``, ``latest_rows``)

Ties and conflicts are reported as ``"unresolved"``. Re-allocation uses a
three-level :class:`TierPolicy`; six published presets are in ``PRESETS``.
All operators are lazy ``DataFrame -> DataFrame`` functions built from
partially aggregated ``groupBy`` steps; see README for the plans.
"""

from .operators.dedupe import dedupe
from .operators.latest import latest_by_entity, latest_rows, latest_value_by_entity
from .operators.modal import attach_modal, modal_by_entity
from .operators.summary import N_RECORDS, compare_policies, merge_summaries, prepare_counts, summarise
from .operators.tiers import assign_tier, keep_top_tier, top_tier_by_entity
from .plans.runs import check_no_sentinel, manifest, prepare, resolve, run, run_and_save, sentinel_rows
from .plans.skew import split_join
from .plans.spec import (
    DATASET_RULES,
    DEFAULT_PRESET,
    PRESETS,
    UNRESOLVED,
    ColumnSpec,
    Rule,
    RunConfig,
    TierPolicy,
    preset,
)
from .sources.io import read_input, read_saved, save, save_run
from .sources.state import SummaryState

__all__ = [
    "ColumnSpec", "TierPolicy", "Rule", "RunConfig", "PRESETS", "DEFAULT_PRESET", "DATASET_RULES",
    "UNRESOLVED", "preset", "assign_tier", "keep_top_tier", "top_tier_by_entity", "modal_by_entity",
    "attach_modal", "latest_by_entity", "latest_rows", "latest_value_by_entity", "dedupe", "prepare", "resolve", "run", "run_and_save",
    "manifest", "check_no_sentinel", "sentinel_rows", "split_join", "read_input", "read_saved", "save", "save_run",
    "N_RECORDS", "SummaryState", "compare_policies", "merge_summaries", "prepare_counts", "summarise",
]
