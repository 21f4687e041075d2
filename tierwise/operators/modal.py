"""Modal (most frequent) category per entity, with or without re-allocation.

Plan shape (both forms):

1. ``groupBy(entity, category)`` counts records. The aggregation is partial
   before its shuffle, so an entity with millions of records ships at most one
   row per category per map task.
2. ``groupBy(entity)`` over those counts takes ``max(struct(tier, n, c))`` and
   ``min(struct(-tier, -n, c))``: both pick the best tier, then the highest
   count in it; the first breaks a tie by the largest code, the second by the
   smallest. They differ exactly when two codes share the top count, which is
   reported as ``unresolved``.

With re-allocation the tier of a code leads the comparison, so only codes at
the entity's highest tier compete; without it every code is tier 0. A NULL
code counts zero (``count`` skips NULL), so it is the modal value only when an
entity has nothing else at its best tier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tiers import tier_of
from ..plans.skew import check_new, split_join
from ..plans.spec import RESERVED_PREFIX, UNRESOLVED, ColumnSpec, TierPolicy

P = RESERVED_PREFIX
N_ROWS = P + "n"


def count_aggs(spec: ColumnSpec, weight: str | None = None) -> list[Column]:
    """n = records with a code, rows = all records; a row counts ``weight`` records (default: one)."""
    if weight is None:
        return [F.count(spec.category).alias(P + "cnt"), F.count(F.lit(1)).alias(N_ROWS)]
    coded = F.when(F.col(spec.category).isNotNull(), F.col(weight)).otherwise(F.lit(0))
    return [F.sum(coded).alias(P + "cnt"), F.sum(weight).alias(N_ROWS)]


def category_counts(df: DataFrame, spec: ColumnSpec, policy: TierPolicy | None, weight: str | None = None) -> DataFrame:
    """(entity, category, tier, n = non-NULL records, rows = all records)."""
    counts = df.groupBy(spec.entity, spec.category).agg(*count_aggs(spec, weight))
    tier = tier_of(spec.category, policy) if policy is not None and policy.reallocate else F.lit(0)
    return counts.withColumn(P + "tier", tier)


def modal_aggs(spec: ColumnSpec) -> list:
    """Aggregates over ``category_counts`` rows that settle the modal value."""
    c, t, n = spec.category, P + "tier", P + "cnt"
    return [
        F.max(F.struct(F.col(t).alias("t"), F.col(n).alias("n"), F.col(c).alias("c"))).alias(P + "hi"),
        F.min(F.struct((-F.col(t)).alias("t"), (-F.col(n)).alias("n"), F.col(c).alias("c"))).alias(P + "lo"),
    ]


def modal_value() -> Column:
    hi, lo = F.col(P + "hi"), F.col(P + "lo")
    return F.when(hi["c"].eqNullSafe(lo["c"]), hi["c"]).otherwise(F.lit(UNRESOLVED))


def modal_by_entity(
    df: DataFrame,
    spec: ColumnSpec,
    policy: TierPolicy | None = None,
    *,
    out: str = "modal",
    reallocate: bool | None = None,
    with_counts: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """One row per entity (NULL entities form one group): ``entity, <out>``.

    ``weight`` names a column that says how many records a row stands for, as
    ``n_records`` does in a summary (:mod:`tierwise.operators.summary`).

    ``policy=None`` or ``reallocate=False`` counts every record (no tiers).
    ``with_counts`` adds the entity's record count (column ``n_records``).
    """
    spec = spec.resolved(df)
    if reallocate is None:
        reallocate = policy is not None and policy.reallocate
    counts = category_counts(df, spec, policy if reallocate else None, weight)
    best = counts.groupBy(spec.entity).agg(*modal_aggs(spec), F.sum(N_ROWS).alias(N_ROWS))
    cols = [F.col(spec.entity), modal_value().alias(out)]
    if with_counts:
        cols.append(F.col(N_ROWS).alias("n_records"))
    return best.select(*cols)


def attach_modal(
    df: DataFrame,
    spec: ColumnSpec,
    policy: TierPolicy | None = None,
    *,
    out: str = "modal",
    reallocate: bool | None = None,
    diagnostics: bool = False,
    **split_opts,
) -> DataFrame:
    """Every input record plus its entity's modal value.

    With re-allocation the result is attached by plain equality, so records
    with a NULL entity get NULL; without it NULL entities are one group and get
    that group's value. ``diagnostics`` (no re-allocation only) adds the exact
    helper columns ``count_of_category`` (records of this code for this
    entity), ``max_count_of_category`` and ``n_tied`` (codes at that count).
    """
    spec = spec.resolved(df)
    if reallocate is None:
        reallocate = policy is not None and policy.reallocate
    if diagnostics:
        if reallocate:
            raise ValueError("diagnostics are defined for the no-re-allocation form only")
        return _attach_with_diagnostics(df, spec, out, **split_opts)
    check_new(df, [out])
    # the summary's own counts find the hot keys: its shuffle serves both
    summary = modal_by_entity(df, spec, policy, out=out, reallocate=reallocate, with_counts=True)
    summary = summary.withColumnRenamed("n_records", N_ROWS)
    return split_join(
        df, summary, [spec.entity], how="left", null_safe=not reallocate, count_col=N_ROWS,
        spread_by=[spec.entity, spec.category], **split_opts,
    )


def _attach_with_diagnostics(df: DataFrame, spec: ColumnSpec, out: str, **split_opts) -> DataFrame:
    """Records + modal + exact helper columns, from aggregations only.

    * per (entity, code): its count (``count_of_category``);
    * per (entity, count): how many codes have that count, and the largest and
      smallest of them;
    * per entity: ``max(struct(count, codes, largest, smallest))`` is the top
      count, the number of codes tied at it (``n_tied``) and the modal value
      (largest = smallest, else ``unresolved``).
    Every step is a partially aggregated ``groupBy``; the per-entity results
    reach the per-code rows, and those the records, through ``split_join``.
    """
    e, c = spec.entity, spec.category
    check_new(df, [out, "count_of_category", "max_count_of_category", "n_tied"])
    counts = category_counts(df, spec, None)  # e, c, cnt, n, tier (0)
    per_entity = (
        counts.groupBy(e, P + "cnt")
        .agg(
            F.count(c).alias(P + "k"),
            F.max(c).alias(P + "cmax"),
            F.min(c).alias(P + "cmin"),
            F.count(F.lit(1)).alias(P + "codes"),
        )
        .groupBy(e)
        .agg(
            F.max(
                F.struct(
                    F.col(P + "cnt").alias("n"),
                    F.col(P + "k").alias("k"),
                    F.col(P + "cmax").alias("hi"),
                    F.col(P + "cmin").alias("lo"),
                )
            ).alias(P + "mt"),
            F.sum(P + "codes").alias(P + "codes"),
        )
    )
    mt = F.col(P + "mt")
    per_entity = per_entity.select(
        e,
        P + "codes",
        mt["n"].alias("max_count_of_category"),
        mt["k"].alias("n_tied"),
        F.when(mt["hi"].eqNullSafe(mt["lo"]), mt["hi"]).otherwise(F.lit(UNRESOLVED)).alias(out),
    )
    # NULL entities are one group here, as in a window partitioned by the entity.
    per_code = split_join(
        counts.select(e, c, F.col(P + "cnt").alias("count_of_category")),
        per_entity.drop(P + "codes"),
        [e],
        how="inner",
        null_safe=True,
        **split_opts,
    )
    # weights per (entity, code): the counting step's own rows
    return split_join(
        df,
        per_code,
        [e, c],
        how="left",
        null_safe=True,
        count_col=N_ROWS,
        key_counts=counts.select(e, c, N_ROWS),
        spread_by=[e, c],
        **split_opts,
    )
