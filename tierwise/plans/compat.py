"""Call-compatible entry points for existing scripts.

Scripts written against the original five functions can switch by changing
their import; arguments keep their order and meaning, and the modal/latest
functions still return ``(DataFrame, list_of_counts)`` pairs where the
original did. Each function only builds a spec and a policy and calls the
tierwise operator; see those for the plans.

Deliberate differences (see README): distinct counts are exact, a source
table value outside apc/ae/op is not a recognised source, an unknown
``dataset`` name is an error, retained records are deterministic, and only the
result column (plus the tier for the re-allocation step, and the documented
helper columns of the no-re-allocation modal) is added to the input columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.latest import latest_rows
from ..operators.modal import attach_modal
from ..operators.tiers import keep_top_tier
from .spec import ColumnSpec, Rule, TierPolicy

# Fixed signatures: names and argument order of the functions below must match
# what existing scripts call. The original's hard-coded column names for the two rules.
SOURCE_COLUMN = "table"
FLAG_COLUMN = "ethnicity_code_present"


def _spec(nhs_col: str, ethnicity_col: str, date_col: str | None = None) -> ColumnSpec:
    return ColumnSpec(
        entity=nhs_col,
        category=ethnicity_col,
        observed_at=date_col or "observed_at",
        source=SOURCE_COLUMN,
        flag=FLAG_COLUMN,
    )


def _policy(not_valid, other) -> TierPolicy:
    return TierPolicy("custom", tuple(not_valid or ()), tuple(other or ()))


def initial_clean(
    dataframe: DataFrame, ethnicity_col: str, nhs_col: str, other_list, not_valid_list, *, is_other: bool = False
) -> DataFrame:
    """Keep each person's highest-tier records; adds ``ethnicity_hierarchy``
    (and, with ``is_other``, the column of that name)."""
    return keep_top_tier(
        dataframe, _spec(nhs_col, ethnicity_col), _policy(not_valid_list, other_list), tier_col="ethnicity_hierarchy",
        is_other="is_other" if is_other else None,
    )


def get_modal_ethnicity(dataframe, nhs_col, ethnicity_col, dataset, list_of_counts, not_valid, other):
    """Every record plus ``modal_ethnicity`` (re-allocated)."""
    Rule.for_dataset(dataset)  # validate the name
    out = attach_modal(
        dataframe, _spec(nhs_col, ethnicity_col), _policy(not_valid, other), out="modal_ethnicity", reallocate=True
    )
    return out, list_of_counts


def get_latest_ethnicity(dataframe, date_col, nhs_col, ethnicity_col, dataset, list_of_counts, not_valid, other, *, helper_columns=False):
    """Latest records with ``latest_ethnicity`` (re-allocated); GP keeps same-day repeats.
    ``helper_columns`` adds the exact ``max_date``, ``tier``, ``n_codes`` and, for HES, ``source_rank``."""
    out = latest_rows(
        dataframe,
        _spec(nhs_col, ethnicity_col, date_col),
        Rule.for_dataset(dataset),
        _policy(not_valid, other),
        reallocate=True,
        out="latest_ethnicity",
        diagnostics=helper_columns,
    )
    return out, list_of_counts


def get_modal_ethnicity_no_reallocation(dataframe, nhs_col, ethnicity_col, dataset):
    """Every record plus ``modal_ethnicity`` and the exact helper columns
    ``count_of_ethnicity``, ``max_count_of_ethnicity``, ``multiple_max_ethnicities``."""
    Rule.for_dataset(dataset)
    out = attach_modal(
        dataframe, _spec(nhs_col, ethnicity_col), None, out="modal_ethnicity", reallocate=False, diagnostics=True
    )
    return (
        out.withColumnRenamed("count_of_category", "count_of_ethnicity")
        .withColumnRenamed("max_count_of_category", "max_count_of_ethnicity")
        .withColumnRenamed("n_tied", "multiple_max_ethnicities")
    )


def get_latest_ethnicity_no_reallocation(dataframe, date_col, nhs_col, ethnicity_col, dataset, *, helper_columns=False):
    """Latest records with ``latest_ethnicity`` (no re-allocation). ``helper_columns`` adds
    the exact ``max_date`` and, for HES, ``source_rank``."""
    return latest_rows(
        dataframe,
        _spec(nhs_col, ethnicity_col, date_col),
        Rule.for_dataset(dataset),
        None,
        reallocate=False,
        out="latest_ethnicity",
        diagnostics=helper_columns,
    )
