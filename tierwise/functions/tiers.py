"""Column expressions for the re-allocation tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.spec import TierPolicy

# Tier labels. With an empty "other" list there are only two levels, 0 and 1.
NOT_VALID, OTHER = 0, 1


def top_tier(policy: TierPolicy) -> int:
    return 2 if policy.other else 1


def tier_of(category: str | Column, policy: TierPolicy) -> Column:
    """Tier of a category code under ``policy``: higher is better.

    ``not_valid`` is tested first, so a code in both lists is not valid. A NULL
    code is in neither list (``IN`` gives NULL, which is not true), so it falls
    through to the top tier, as in the original method; runs remove NULL
    codes beforehand (:func:`tierwise.plans.runs.prepare`).
    """
    c = F.col(category) if isinstance(category, str) else category
    expr = F.when(c.isin(list(policy.not_valid)), F.lit(NOT_VALID))
    if policy.other:
        expr = expr.when(c.isin(list(policy.other)), F.lit(OTHER))
    return expr.otherwise(F.lit(top_tier(policy)))


def other_of(category: str | Column, policy: TierPolicy) -> Column:
    """1 where the code is in the policy's "other" list, else 0."""
    c = F.col(category) if isinstance(category, str) else category
    return F.coalesce(c.isin(list(policy.other)), F.lit(False)).cast("int") if policy.other else F.lit(0)
