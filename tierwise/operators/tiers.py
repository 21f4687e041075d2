"""Re-allocation: tier every record, keep each entity's best tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tiers import other_of, tier_of, top_tier
from ..plans.skew import check_new, split_join
from ..plans.spec import RESERVED_PREFIX, ColumnSpec, TierPolicy


def assign_tier(
    df: DataFrame, spec: ColumnSpec, policy: TierPolicy, out: str = "tier", *, is_other: str | None = None
) -> DataFrame:
    """Add the record's tier (0 not valid, 1 other, 2 valid; 0/1 without an other
    list); ``is_other`` names a column for "the code is in the other list" (0/1)."""
    spec = spec.resolved(df)
    check_new(df, [out, *([is_other] if is_other else [])])
    df = df.withColumn(out, tier_of(spec.category, policy))
    return df.withColumn(is_other, other_of(spec.category, policy)) if is_other else df


def top_tier_by_entity(df: DataFrame, spec: ColumnSpec, policy: TierPolicy) -> DataFrame:
    """One row per entity (NULL entities form one group): ``entity,
    top_tier, n_records``."""
    spec = spec.resolved(df)
    return df.groupBy(spec.entity).agg(
        F.max(tier_of(spec.category, policy)).alias("top_tier"),
        F.count(F.lit(1)).alias("n_records"),
    )


def keep_top_tier(
    df: DataFrame,
    spec: ColumnSpec,
    policy: TierPolicy,
    *,
    tier_col: str | None = "tier",
    is_other: str | None = None,
    **split_opts,
) -> DataFrame:
    """Keep only the records at their entity's highest tier.

    An entity whose records are all "not valid" keeps them all (its best tier
    is 0); no entity is ever removed. NULL entities are one group, as in a window
    partitioned by the entity.

    Records at the policy's highest tier are kept whatever else their entity holds,
    so they go straight from the scan to the result. Only the others meet a
    per-entity summary (a partially aggregated ``groupBy``), cut down to the
    entities without a record at the highest tier, in a hot-key aware join: an
    entity that holds a large share of the rows is split over many tasks. So the
    records that cross the network are those below the highest tier.
    """
    spec = spec.resolved(df)
    check_new(df, [c for c in (tier_col, is_other) if c])
    best, n, tier = (RESERVED_PREFIX + x for x in ("top", "n", "tier"))
    settled = top_tier(policy)
    rows = df.withColumn(tier, tier_of(spec.category, policy))
    lower = F.col(tier) < settled
    # the counts of the same aggregate find the hot keys among the lower records: one shuffle, one read
    top = rows.groupBy(spec.entity).agg(F.max(tier).alias(best), F.count(F.when(lower, F.lit(1))).alias(n)).where(F.col(best) < settled)
    joined = split_join(
        rows.where(lower), top, [spec.entity], how="inner", null_safe=True, count_col=n,
        spread_by=[spec.entity, spec.category], **split_opts,
    )
    kept = rows.where(~lower).unionByName(joined.where(F.col(tier) == F.col(best)).drop(best))
    cols = [F.col(c) for c in df.columns]
    if tier_col:
        cols.append(F.col(tier).alias(tier_col))
    if is_other:
        cols.append(other_of(spec.category, policy).alias(is_other))
    return kept.select(*cols)
