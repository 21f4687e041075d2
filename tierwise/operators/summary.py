"""A summary of records that answers every policy, method and rule.

No policy, method or rule tells apart records that agree in entity, category,
source and flag but for the date, and of those only the latest date matters:

* modal counts records by entity and category;
* a tier depends on the category alone;
* every order key of the latest method is the date, preceded by the tier and
  followed by the source's rank or the flag, so among records that agree in these
  the one with the latest date has the best key.

So ``groupBy(entity, category, source, flag)`` with a count and the latest date
loses nothing. Its buffers are of fixed width for dates and numbers (a hash
aggregate), its rows are few per entity, and two summaries
merge by adding counts and taking the later date. Records are dealt by all four
columns before they are counted, so that a task holds a bounded number of groups;
records that agree in all four meet in one task, which streams them into one row. A summary has the columns of
the records that it stands for, and ``n_records``: the operators for whole entities
take it in place of the records (``modal_by_entity(..., weight=N_RECORDS)``,
``latest_by_entity``, ``resolve(..., weight=N_RECORDS)``).

Records without an entity or a category are kept, as rows of their own: they say
how many records :func:`tierwise.plans.runs.prepare` removes, without a read.
Sources that the spec's order doesn't list count as NULL, as in every rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tiers import tier_of
from ..plans.skew import check_new
from ..plans.spec import RESERVED_PREFIX, UNRESOLVED, ColumnSpec, Rule, TierPolicy
from .latest import TIER, LatestPlan
from .modal import count_aggs, modal_aggs, modal_value

P = RESERVED_PREFIX
N_RECORDS = "n_records"
#: Rows that a task aggregates: partitions that Spark sizes by compressed bytes hold millions.
TASK_ROWS = 200_000


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks for ``rows`` rows, at least the session's parallelism."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def _roles(df: DataFrame, spec: ColumnSpec) -> list[str]:
    """The columns that a summary groups by; source and flag only where ``df`` has them."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keys = [spec.entity, spec.category]
    if isinstance(kinds.get(spec.source), T.StringType):
        keys.append(spec.source)
    if isinstance(kinds.get(spec.flag), (T.IntegralType, T.BooleanType)):
        keys.append(spec.flag)
    return list(dict.fromkeys(keys))


def summarise(df: DataFrame, spec: ColumnSpec, *, rows: int | None = None) -> DataFrame:
    """(entity, category, source, flag, observed_at = the latest, n_records), one row for
    each combination that occurs. Source and flag are left out where ``df`` lacks them.

    ``rows`` says how many records there are at most (default: they are counted). Tasks
    take ``TASK_ROWS`` of them on average, so their memory does not grow with the table.
    Summaries with the same ``rows`` are merged where they are."""
    spec = spec.resolved(df, Rule.NONE)
    check_new(df, [N_RECORDS])
    keys = _roles(df, spec)
    if spec.source in keys:
        listed = F.when(F.col(spec.source).isin(list(spec.source_order)), F.col(spec.source))
        df = df.withColumn(spec.source, listed)
    dealt = df.select(*dict.fromkeys([*keys, spec.observed_at])).repartition(tasks_for(df, df.count() if rows is None else rows), *keys)
    return dealt.groupBy(*keys).agg(F.max(spec.observed_at).alias(spec.observed_at), F.count(F.lit(1)).alias(N_RECORDS))


def merge_summaries(first: DataFrame, *others: DataFrame, spec: ColumnSpec) -> DataFrame:
    """The summary of all records that the given summaries stand for. They must come
    from disjoint sets of records and have the same columns."""
    for other in others:
        if set(other.columns) != set(first.columns):
            raise ValueError(f"summaries differ in columns: {sorted(first.columns)}, {sorted(other.columns)}")
    spec = spec.resolved(first, Rule.NONE)
    rows = reduce(DataFrame.unionByName, others, first)
    merged = rows.groupBy(*_roles(first, spec)).agg(F.max(spec.observed_at).alias(spec.observed_at), F.sum(N_RECORDS).alias(N_RECORDS))
    return merged.select(*first.columns)


def prepare_counts(summary: DataFrame, spec: ColumnSpec) -> DataFrame:
    """One row: n_records, n_removed (without an entity or a category) and n_sentinel
    (whose category is the result marker), of the records that the summary stands for."""
    spec = spec.resolved(summary)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col(N_RECORDS))), F.lit(0))
    return summary.agg(
        n(F.lit(True)).alias(N_RECORDS),
        n(F.col(spec.entity).isNull() | F.col(spec.category).isNull()).alias("n_removed"),
        n(F.col(spec.category) == UNRESOLVED).alias("n_sentinel"),
    )


def compare_policies(
    summary: DataFrame,
    spec: ColumnSpec,
    policies: list[TierPolicy],
    rule: Rule = Rule.NONE,
    *,
    policy_col: str = "policy",
    modal_col: str = "modal",
    latest_col: str = "latest",
) -> DataFrame:
    """One row per entity and policy: ``entity, policy, modal, latest``, for re-allocating
    policies and others alike, in one pass over a summary (or over records, summarised
    on the way: one scan for all policies).

    The summary's rows are folded to one per entity and category, with the count and
    the best key of every form of the rule, and dealt by entity; each is repeated once a
    policy, with the tier that the policy gives it, and one aggregation per entity and
    policy settles both methods where the rows are. Tasks of every step take ``TASK_ROWS``
    rows on average, in the last step of the repeated ones; the rows are counted first. As in :func:`tierwise.plans.runs.resolve`, where a NULL category shares
    the latest key with a real one, the real one is reported.
    """
    if len({p.name for p in policies}) != len(policies):
        raise ValueError("policies need names of their own")
    n_rows = summary.count()
    if N_RECORDS not in summary.columns:
        summary = summarise(summary, spec, rows=n_rows)
    tasks = tasks_for(summary, n_rows)
    spec = spec.resolved(summary, rule)
    again = LatestPlan(summary, spec, rule, TierPolicy("any"), True, tag="a_")
    plain = LatestPlan(summary, spec, rule, None, False, tag="p_")
    plans = (again, plain)

    dealt = summary.repartition(tasks, spec.entity, spec.category)  # before the keys are made: narrower rows move
    keyed = plain.with_keys(again.with_keys(dealt, F.lit(0)))
    keys = [plan.P + "k_" + f for plan in plans for f in plan.families]
    per_code = keyed.groupBy(spec.entity, spec.category).agg(*count_aggs(spec, N_RECORDS), *[F.max(k).alias(k) for k in keys])

    def described(p: TierPolicy) -> Column:
        tier = tier_of(spec.category, p) if p.reallocate else F.lit(0)
        return F.struct(F.lit(p.name).alias("name"), F.lit(p.reallocate).alias("again"), tier.alias("tier"))

    # dealt by entity before a row is repeated: the last aggregation then needs no shuffle
    repeated = tasks_for(summary, n_rows * len(policies))
    rows = per_code.repartition(repeated, spec.entity).withColumn(P + "p", F.explode(F.array(*[described(p) for p in policies])))
    rows = rows.withColumns({policy_col: F.col(P + "p")["name"], P + "again": F.col(P + "p")["again"], TIER: F.col(P + "p")["tier"]})
    rows = rows.withColumn(P + "tier", F.col(TIER))
    for f in again.families:
        k = F.col(again.P + "k_" + f)
        rows = rows.withColumn(again.P + "k_" + f, F.when(k.isNotNull() & F.col(P + "again"), k.withField("t", F.col(TIER))))
    for f in plain.families:
        k = F.col(plain.P + "k_" + f)
        rows = rows.withColumn(plain.P + "k_" + f, F.when(~F.col(P + "again"), k))
    settled = rows.groupBy(spec.entity, policy_col).agg(
        F.max(P + "again").alias(P + "again"), *modal_aggs(spec), *[a for plan in plans for a in plan.aggs(rows=False)]
    )
    first = lambda plan: F.try_element_at(plan.value_structs(plan.decide(), rows=False), F.lit(1))["v"]
    latest = F.when(F.col(P + "again"), first(again)).otherwise(first(plain))
    return settled.select(spec.entity, policy_col, modal_value().alias(modal_col), latest.alias(latest_col))
