"""Latest (most recent) category per entity, with or without re-allocation.

The original method is a chain of window filters: keep the best tier, keep the
best source per day, keep the latest day, keep the highest flag, then call the
day a conflict when more than one code is left. A chain of "keep rows equal to
the group's max/min" filters is a lexicographic maximum, so each form is one
order key per record (see ``LatestPlan``) and the records kept are the ones
whose key equals the entity's best key.

Plan shape: one ``groupBy(entity)`` with partial aggregation.

* ``max(struct(key..., c))``               the best key B and the largest code at B
* ``min(struct(-key..., c))``, or          the smallest code at B
  ``max(struct(key..., complement(c)))``
* ``max(key)`` over NULL codes             whether a NULL code sits at B

The second form stands where the date is no number that can be negated: a code's
complement orders codes the other way round, so a date may be of any type that
Spark orders (texts, intervals, structs, NaN).

Largest <> smallest is the exact "several codes on the latest date" test.
Because all of these are plain aggregates, an entity with a huge share of
the records costs one partial row per map task; no window ever buffers a
whole entity. Output rows are picked with ``max_by`` on (key, tie-break
columns), so the records returned are deterministic. The flag rule keeps every
record at the best key (they are not de-duplicated); those are found by
joining the per-entity best key back with :func:`~tierwise.plans.skew.split_join`.

Forms, per rule (``nd1`` = exactly one non-NULL code at the entity's top tier):

========  ===========================================  ==================================
form      key, higher is better (eligible rows)        then
========  ===========================================  ==================================
A3 NONE   (tier, date)          date not NULL          B.tier must be the top tier
A3 SOURCE nd1: as NONE; else (tier, date, -rank)       rank not NULL to be eligible
A3 FLAG   nd1: as NONE; else (tier, date, has flag,    B must have a flag
          flag)
A5 NONE   (date)                                       NULL codes give no output
A5 SOURCE (date, has rank, -rank)                      B must have a rank
A5 FLAG   (date, has code, has flag, flag)             B must have a code and a flag
========  ===========================================  ==================================
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import canonical, complement, key, orderable, source_rank, time_key
from ..functions.tiers import tier_of
from ..plans.skew import check_new, split_join
from ..plans.spec import RESERVED_PREFIX, UNRESOLVED, ColumnSpec, Rule, TierPolicy

P = RESERVED_PREFIX
N_ROWS = P + "n"
TIER = P + "t"


@dataclass(frozen=True)
class _Family:
    name: str
    parts: tuple[str, ...]  # key component names, in order
    key: Column  # struct of the parts, NULL when the row is not eligible


class LatestPlan:
    """Columns and aggregates for one form of the latest-category operator."""

    def __init__(
        self,
        df: DataFrame,
        spec: ColumnSpec,
        rule: Rule,
        policy: TierPolicy | None,
        reallocate: bool,
        tie_break: list[str] | None = None,
        tag: str = "",
    ):
        """``tag`` keeps the helper columns of several plans over one table apart."""
        spec = spec.resolved(df, rule)
        self.P = P + tag
        if reallocate and policy is None:
            raise ValueError("re-allocation needs a TierPolicy")
        self.spec, self.rule, self.policy, self.reallocate = spec, rule, policy, reallocate
        self.input_cols = list(df.columns)
        self.tie_break = list(tie_break or [])
        for c in self.tie_break:
            if c not in df.columns:
                raise ValueError(f"tie-break column {c!r} not in input")
        self.unordered = {f.name: f.dataType for f in df.schema.fields if not orderable(f.dataType)}
        self.order_cols = [c for c in self.tie_break if c not in self.unordered] + [
            f.name for f in df.schema.fields if f.name not in self.tie_break and f.name not in self.unordered
        ]
        d, self.negatable = time_key(spec.observed_at, df.schema[spec.observed_at].dataType, spec.date_grain)
        c = F.col(spec.category)
        dated = d.isNotNull()
        self.families: dict[str, _Family] = {}

        def fam(name, parts, elig):
            names = tuple(n for n, _ in parts)
            self.families[name] = _Family(name, names, F.when(elig, key(*parts)))

        if reallocate:
            t = F.col(TIER)
            fam("n", [("t", t), ("d", d)], dated)
            if rule is Rule.SOURCE:
                r = source_rank(spec.source, spec.source_order)
                fam("x", [("t", t), ("d", d), ("r", -r)], dated & r.isNotNull())
            elif rule is Rule.FLAG:
                f = F.col(spec.flag).cast("int")
                fam("x", [("t", t), ("d", d), ("fn", f.isNotNull().cast("int")), ("f", F.coalesce(f, F.lit(0)))], dated)
        else:
            if rule is Rule.NONE:
                fam("n", [("d", d)], dated)
            elif rule is Rule.SOURCE:
                r = source_rank(spec.source, spec.source_order)
                fam("n", [("d", d), ("rn", r.isNotNull().cast("int")), ("r", -F.coalesce(r, F.lit(0)))], dated)
            else:
                f = F.col(spec.flag).cast("int")
                fam(
                    "n",
                    [
                        ("d", d),
                        ("cn", c.isNotNull().cast("int")),
                        ("fn", f.isNotNull().cast("int")),
                        ("f", F.coalesce(f, F.lit(0))),
                    ],
                    dated,
                )

    # -- row level ---------------------------------------------------------
    def with_keys(self, df: DataFrame, tier: Column | None = None) -> DataFrame:
        """Add the tier (re-allocation only; by default the policy's) and one key column per family."""
        if self.reallocate:
            df = df.withColumn(TIER, tier_of(self.spec.category, self.policy) if tier is None else tier)
        for f in self.families.values():
            df = df.withColumn(self.P + "k_" + f.name, f.key)
        return df

    # -- per entity ----------------------------------------------------------
    def aggs(self, *, rows: bool) -> list[Column]:
        """Aggregates over units (records, or per-(entity, code) groups whose
        key columns hold the group's best key). ``rows`` adds the
        representative-record aggregates."""
        c = F.col(self.spec.category)
        out = []
        if self.reallocate:
            t = F.col(TIER)
            out.append(F.max(t).alias(self.P + "top"))
            if len(self.families) > 1:
                out.append(F.max(F.when(c.isNotNull(), F.struct(t.alias("t"), c.alias("c")))).alias(self.P + "hit"))
                out.append(F.min(F.when(c.isNotNull(), F.struct((-t).alias("t"), c.alias("c")))).alias(self.P + "lot"))
        for f in self.families.values():
            k = F.col(self.P + "k_" + f.name)
            has_code = k.isNotNull() & c.isNotNull()
            # Flat structs (no nested key struct) keep the shuffled buffers small.
            # hi: best key, then the largest code (NULL sorts lowest, so a code
            # wins over NULL at the same key); lo: over records with a code,
            # best key then the smallest code (or its complement).
            out.append(
                F.max(F.when(k.isNotNull(), F.struct(*[k[p].alias(p) for p in f.parts], c.alias("c")))).alias(
                    self.P + "hi_" + f.name
                )
            )
            if self._needs_lo(f.name):
                if self.negatable:
                    lo = F.min(F.when(has_code, F.struct(*[(-k[p]).alias(p) for p in f.parts], c.alias("c"))))
                else:
                    lo = F.max(F.when(has_code, F.struct(*[k[p].alias(p) for p in f.parts], complement(c).alias("c"))))
                out.append(lo.alias(self.P + "lo_" + f.name))
            if self.reallocate:
                out.append(F.max(F.when(c.isNull(), k)).alias(self.P + "nul_" + f.name))
            if rows:
                out += self._record_aggs(f, k, has_code, self.P + "rv_" + f.name)
                if self.reallocate:
                    out += self._record_aggs(f, k, k.isNotNull() & c.isNull(), self.P + "rn_" + f.name)
        return out

    def _record_aggs(self, f: _Family, k: Column, cond: Column, name: str) -> list[Column]:
        """The representative record among rows meeting ``cond``: the maximum
        of (key, tie-break columns, other orderable columns, canonical forms of
        the others). One struct both orders and carries the record, so no column
        is buffered twice; only columns that Spark has no order for (maps) ride
        along in a ``max_by``, decided by their canonical forms at last."""
        ordered = F.struct(
            *[k[p].alias(self.P + "key_" + p) for p in f.parts],
            *[F.col(x) for x in self.order_cols],
            *[canonical(F.col(x), dt).alias(self.P + "form_" + x) for x, dt in self.unordered.items()],
        )
        aggs = [F.max(F.when(cond, ordered)).alias(name)]
        if self.unordered:
            rest = F.struct(*[F.col(x) for x in self.unordered])
            aggs.append(F.max_by(rest, F.when(cond, ordered)).alias(name + "_x"))
        return aggs

    def _needs_lo(self, name: str) -> bool:
        # With a rule, family "n" only serves entities with exactly one code at
        # their top tier, which cannot have a conflict: no smallest code needed.
        return not (name == "n" and "x" in self.families)

    def best_key(self, name: str) -> Column:
        """The entity's best key for family ``name``, as the row key struct."""
        hi = F.col(self.P + "hi_" + name)
        return F.when(hi.isNotNull(), F.struct(*[hi[p].alias(p) for p in self.families[name].parts]))

    def _decide_family(self, name: str) -> dict[str, Column]:
        hi = F.col(self.P + "hi_" + name)
        b = self.best_key(name)
        # the largest code at the best key (NULL if only NULL codes are there);
        # when there is one, lo's best key among coded records is the same key
        cmax = hi["c"]
        lowest = F.col(self.P + "lo_" + name)["c"] if self._needs_lo(name) else None
        valid = b.isNotNull()
        if self.reallocate:
            valid = valid & (b["t"] == F.col(self.P + "top"))
            if name == "x" and self.rule is Rule.FLAG:
                valid = valid & (b["fn"] == 1)
            has_null = F.coalesce(F.col(self.P + "nul_" + name) == b, F.lit(False))
        else:
            if self.rule is Rule.SOURCE:
                valid = valid & (b["rn"] == 1)
            elif self.rule is Rule.FLAG:
                valid = valid & (b["cn"] == 1) & (b["fn"] == 1)
            valid = valid & cmax.isNotNull()
            has_null = F.lit(False)
        highest = cmax if self.negatable else complement(cmax)
        conflict = F.lit(False) if lowest is None else F.coalesce(highest != lowest, F.lit(False))
        return {"valid": F.coalesce(valid, F.lit(False)), "cmax": cmax, "conflict": conflict, "has_null": has_null}

    def decide(self) -> dict[str, Column]:
        """Per-entity result columns: valid, cmax, conflict, has_null, nd1."""
        n = self._decide_family("n")
        if "x" not in self.families:
            n["nd1"] = F.lit(True)
            return n
        x = self._decide_family("x")
        hit, lot = F.col(self.P + "hit"), F.col(self.P + "lot")
        nd1 = F.coalesce((hit["t"] == F.col(self.P + "top")) & (hit["c"] == lot["c"]), F.lit(False))
        out = {k: F.when(nd1, n[k]).otherwise(x[k]) for k in n}
        out["nd1"] = nd1
        return out

    def value_structs(self, d: dict[str, Column], *, rows: bool) -> Column:
        """Array of this entity's output values (and records)."""

        def record(col: Column) -> Column:  # drop the key fields
            return F.struct(*[col[c].alias(c) for c in self.order_cols])

        def pick(prefix):
            if "x" not in self.families:
                return record(F.col(prefix + "n"))
            return F.when(d["nd1"], record(F.col(prefix + "n"))).otherwise(record(F.col(prefix + "x")))

        def item(value: Column, row_prefix: str | None):
            fields = [value.alias("v")]
            if rows:
                fields.append(pick(row_prefix).alias("row"))
                if self.unordered:
                    fields.append(pick_x(row_prefix).alias("row_x"))
            return F.struct(*fields)

        def pick_x(prefix):
            if "x" not in self.families:
                return F.col(prefix + "n_x")
            return F.when(d["nd1"], F.col(prefix + "n_x")).otherwise(F.col(prefix + "x_x"))

        unresolved = item(F.lit(UNRESOLVED), self.P + "rv_")
        code = item(d["cmax"], self.P + "rv_")
        null_item = item(F.lit(None).cast("string"), self.P + "rn_") if self.reallocate else None
        cands = [
            F.when(d["valid"] & d["conflict"], unresolved),
            F.when(d["valid"] & ~d["conflict"] & d["cmax"].isNotNull(), code),
        ]
        if null_item is not None:
            cands.append(F.when(d["valid"] & ~d["conflict"] & d["has_null"], null_item))
        return F.filter(F.array(*cands), lambda e: e.isNotNull())


def _resolve_rule(rule) -> Rule:
    """Accept a Rule, a rule name ("none", "source", "flag") or a dataset name."""
    if isinstance(rule, Rule):
        return rule
    try:
        return Rule(rule.lower())
    except ValueError:
        return Rule.for_dataset(rule)


def latest_by_entity(
    df: DataFrame,
    spec: ColumnSpec,
    rule: Rule | str = Rule.NONE,
    policy: TierPolicy | None = None,
    *,
    reallocate: bool | None = None,
    out: str = "latest",
) -> DataFrame:
    """Distinct ``(entity, <out>)`` pairs: the latest code, or ``unresolved``.

    Most entities have one pair. With re-allocation, records with a NULL code
    on the latest date add a NULL pair (the original method returns their own
    NULL code). Entities with no eligible record are absent.
    """
    rule = _resolve_rule(rule)
    if reallocate is None:
        reallocate = policy is not None and policy.reallocate
    plan = LatestPlan(df, spec, rule, policy, reallocate)
    spec = plan.spec
    agg = plan.with_keys(df).groupBy(spec.entity).agg(*plan.aggs(rows=False))
    vals = agg.select(spec.entity, F.explode(plan.value_structs(plan.decide(), rows=False)).alias(P + "o"))
    return vals.select(spec.entity, F.col(P + "o")["v"].alias(out))


def latest_value_by_entity(
    df: DataFrame,
    spec: ColumnSpec,
    rule: Rule | str = Rule.NONE,
    policy: TierPolicy | None = None,
    *,
    reallocate: bool | None = None,
    out: str = "latest",
) -> DataFrame:
    """One row per entity with an eligible record: ``(entity, <out>)``.

    Like :func:`latest_by_entity`, but where a NULL code shares the latest
    key with a real code only the real code is kept, so entities are unique.
    """
    rule = _resolve_rule(rule)
    if reallocate is None:
        reallocate = policy is not None and policy.reallocate
    plan = LatestPlan(df, spec, rule, policy, reallocate)
    spec = plan.spec
    agg = plan.with_keys(df).groupBy(spec.entity).agg(*plan.aggs(rows=False))
    first = F.try_element_at(plan.value_structs(plan.decide(), rows=False), F.lit(1))
    return agg.where(first.isNotNull()).select(spec.entity, first["v"].alias(out))


def latest_rows(
    df: DataFrame,
    spec: ColumnSpec,
    rule: Rule | str = Rule.NONE,
    policy: TierPolicy | None = None,
    *,
    reallocate: bool | None = None,
    out: str = "latest",
    tie_break: list[str] | None = None,
    diagnostics: bool = False,
    entity_cols: DataFrame | None = None,
    summary: DataFrame | None = None,
    **split_opts,
) -> DataFrame:
    """Input records carrying their entity's latest code (column ``out``).

    ``Rule.NONE`` / ``Rule.SOURCE``: one record per (entity, value), chosen as
    the record with the highest (key, ``tie_break`` columns, then all other
    orderable columns), so reruns return the same record. ``Rule.FLAG``: every
    record at the entity's best key, as the original method leaves same-day
    repeats for the caller to de-duplicate (see :func:`tierwise.operators.dedupe.dedupe`).

    ``diagnostics`` adds exact helper columns: ``max_date`` (the entity's
    latest ``observed_at``; with re-allocation, among its top-tier records),
    ``source_rank`` (``Rule.SOURCE``: the record's source priority), and with
    re-allocation ``tier`` (the record's tier) and ``n_codes`` (distinct
    non-NULL codes at the entity's top tier; 1 means the one-code path).

    ``entity_cols`` (at most one row per entity: the entity column and others)
    adds its columns to the records, on the way that the entity's result takes
    anyway; a NULL entity matches a NULL one only without re-allocation.

    ``summary`` (:func:`tierwise.operators.summary.summarise` of the same records,
    stored) spares ``Rule.FLAG`` the first of its two reads of the records.
    """
    rule = _resolve_rule(rule)
    spec = spec.resolved(df, rule)
    check_new(df, [out, *(c for c in (entity_cols.columns if entity_cols is not None else []) if c != spec.entity)])
    if reallocate is None:
        reallocate = policy is not None and policy.reallocate
    result = _latest_rows(df, spec, rule, policy, reallocate, out, tie_break, split_opts, entity_cols, summary)
    if not diagnostics:
        return result
    return _with_diagnostics(result, df, spec, rule, policy, reallocate, split_opts)


def _with_diagnostics(result, df, spec, rule, policy, reallocate, split_opts) -> DataFrame:
    names = ["max_date"] + (["tier", "n_codes"] if reallocate else []) + (
        ["source_rank"] if rule is Rule.SOURCE else []
    )
    check_new(df, names)
    c, d = F.col(spec.category), F.col(spec.observed_at)
    # Per (entity, code) first: an entity's records fold map-side.
    per_code = df.groupBy(spec.entity, spec.category).agg(
        F.max(d).alias(P + "mx"), F.count(F.lit(1)).alias(N_ROWS)
    )
    if reallocate:
        t = tier_of(spec.category, policy)
        per_code = per_code.withColumn(TIER, t)
        top = F.max(TIER)
        aggs = [
            top.alias(P + "top"),
            F.max(F.struct(F.col(TIER).alias("t"), F.col(P + "mx").alias("d"))).alias(P + "td"),
            *[F.count(F.when((F.col(TIER) == i) & c.isNotNull(), F.lit(1))).alias(P + f"nc{i}") for i in range(3)],
        ]
    else:
        aggs = [F.max(P + "mx").alias("max_date")]
    per_entity = per_code.groupBy(spec.entity).agg(*aggs, F.sum(N_ROWS).alias(N_ROWS))
    if reallocate:
        n_codes = F.when(F.col(P + "top") == 2, F.col(P + "nc2")).when(F.col(P + "top") == 1, F.col(P + "nc1")).otherwise(
            F.col(P + "nc0")
        )
        per_entity = per_entity.select(
            spec.entity, N_ROWS, F.col(P + "td")["d"].alias("max_date"), n_codes.alias("n_codes")
        )
    # hot keys from the per-(entity, code) counts, summed: a cheap hash
    # aggregate (counting the derived result rows would recompute them)
    key_counts = per_code.groupBy(spec.entity).agg(F.sum(N_ROWS).alias(N_ROWS))
    joined = split_join(
        result, per_entity, [spec.entity], how="left", null_safe=True,
        count_col=N_ROWS, key_counts=key_counts, spread_by=spec.required(rule), **split_opts,
    )
    extra = []
    if reallocate:
        extra.append(tier_of(spec.category, policy).alias("tier"))
    if rule is Rule.SOURCE:
        extra.append(source_rank(spec.source, spec.source_order).alias("source_rank"))
    return joined.select(*result.columns, *extra, *[n for n in ("n_codes", "max_date") if n in joined.columns])


def _latest_rows(df, spec, rule, policy, reallocate, out, tie_break, split_opts, entity_cols=None, stored=None) -> DataFrame:
    plan = LatestPlan(df, spec, rule, policy, reallocate, tie_break)
    keyed = plan.with_keys(df)
    if rule is not Rule.FLAG:
        agg = keyed.groupBy(spec.entity).agg(*plan.aggs(rows=True))
        vals = agg.select(F.explode(plan.value_structs(plan.decide(), rows=True)).alias(P + "o"))
        found = vals.select(
            *[
                F.col(P + "o")["row_x" if c in plan.unordered else "row"][c].alias(c)
                for c in df.columns
            ],
            F.col(P + "o")["v"].alias(out),
        )
        # two rows per entity at most: a plain join has no hot key here
        return found if entity_cols is None else _with_entity_cols(found, entity_cols, spec.entity, not reallocate)

    # Flag rule: keep every record at the best key. The summary keeps every
    # entity (with a validity flag) so that its row counts describe all rows.
    d = plan.decide()
    units, n_rows = (keyed, F.count(F.lit(1))) if stored is None else (plan.with_keys(stored), F.sum("n_records"))
    summary = (
        units.groupBy(spec.entity)
        .agg(*plan.aggs(rows=False), n_rows.alias(N_ROWS))
        .select(
            spec.entity,
            N_ROWS,
            d["valid"].alias(P + "valid"),
            d["nd1"].alias(P + "nd1"),
            d["conflict"].alias(P + "conflict"),
            *[plan.best_key(f).alias(P + "best_" + f) for f in plan.families],
        )
    )
    added = []
    if entity_cols is not None:
        added = [c for c in entity_cols.columns if c != spec.entity]
        summary = _with_entity_cols(summary, entity_cols, spec.entity, not reallocate)
    # Records that can never sit at a best key need not cross the shuffle:
    # every family's key needs a date, and without re-allocation a NULL code
    # is never returned.
    candidates = keyed.where(F.col(P + "k_n").isNotNull())
    if not reallocate:
        candidates = candidates.where(F.col(spec.category).isNotNull())
    # the summary's own counts (of all the entity's records, an upper bound on
    # the candidates) find the hot keys: its shuffle serves both
    joined = split_join(
        candidates, summary, [spec.entity], how="inner", null_safe=True,
        count_col=N_ROWS, spread_by=spec.required(rule), **split_opts,
    )
    at_best = F.col(P + "k_n") == F.col(P + "best_n")
    if "x" in plan.families:
        at_best = F.when(F.col(P + "nd1"), at_best).otherwise(F.col(P + "k_x") == F.col(P + "best_x"))
    cond = F.col(P + "valid") & at_best
    if not reallocate:
        cond = cond & F.col(spec.category).isNotNull()
    value = F.when(F.col(P + "conflict"), F.lit(UNRESOLVED)).otherwise(F.col(spec.category))
    return joined.where(cond).select(*[F.col(c) for c in df.columns], value.alias(out), *added)


def _with_entity_cols(rows: DataFrame, entity_cols: DataFrame, entity: str, null_safe: bool) -> DataFrame:
    """``rows`` (few per entity) with the columns of ``entity_cols``."""
    if not null_safe:  # keeps the partitioning that both sides share
        return rows.join(entity_cols, on=entity, how="left").select(*rows.columns, *[c for c in entity_cols.columns if c != entity])
    other = entity_cols.withColumnRenamed(entity, P + "le")
    return rows.join(other, F.col(entity).eqNullSafe(F.col(P + "le")), how="left").drop(P + "le")
