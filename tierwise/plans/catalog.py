"""The query catalogue: every operator run over the driver's test tables.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame with only
determined columns (no arbitrary pass-through), every computed column aliased.
Inputs are the mappings in :mod:`tierwise.sources.mappings`, over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import dedupe
from ..operators.latest import latest_by_entity, latest_rows
from ..operators.modal import attach_modal, modal_by_entity
from ..operators.summary import N_RECORDS, compare_policies, merge_summaries, prepare_counts, summarise
from ..operators.tiers import assign_tier, keep_top_tier
from ..sources.io import read_input
from ..sources.mappings import m1_orders, m2_lineitem, m3_events, m4_all_codes
from .runs import manifest, prepare, resolve, run
from .spec import DEFAULT_PRESET, PRESETS, ColumnSpec, Rule, RunConfig, TierPolicy

SPEC = ColumnSpec()
DEFAULT = PRESETS[DEFAULT_PRESET]
NONE = PRESETS["none"]
REALLOC_PRESETS = [p for p in PRESETS if PRESETS[p].reallocate]

Query = Callable[[SparkSession, str], DataFrame]


def _tier_rows(preset: str) -> Query:
    def q(spark, sf):
        t = assign_tier(m2_lineitem(spark, sf), SPEC, PRESETS[preset])
        return t.groupBy("category", "tier").agg(F.count(F.lit(1)).alias("n"))

    return q


def _top_tier(preset: str) -> Query:
    def q(spark, sf):
        kept = keep_top_tier(m2_lineitem(spark, sf), SPEC, PRESETS[preset])
        return kept.groupBy("entity", "category", "tier").agg(F.count(F.lit(1)).alias("n_rows"))

    return q


def _modal(preset: str, mapping=m1_orders) -> Query:
    def q(spark, sf):
        return modal_by_entity(mapping(spark, sf), SPEC, PRESETS[preset])

    return q


def _latest(preset: str, rule: Rule, mapping, *, count_rows=False, **mapping_opts) -> Query:
    def q(spark, sf):
        df = mapping(spark, sf, **mapping_opts)
        if count_rows:
            rows = latest_rows(df, SPEC, rule, PRESETS[preset])
            return rows.groupBy("entity", "latest").agg(F.count(F.lit(1)).alias("n_rows"))
        return latest_by_entity(df, SPEC, rule, PRESETS[preset])

    return q


def modal_attached(spark, sf):
    return attach_modal(m1_orders(spark, sf), SPEC, DEFAULT).select("o_orderkey", "entity", "modal")


def modal_no_realloc_diag(spark, sf):
    a = attach_modal(m1_orders(spark, sf), SPEC, NONE, diagnostics=True)
    return a.select("o_orderkey", "entity", "modal", "count_of_category", "max_count_of_category", "n_tied")


def latest_record_source(spark, sf):
    rows = latest_rows(m1_orders(spark, sf), SPEC, Rule.SOURCE, DEFAULT)
    return rows.select("entity", "o_orderkey", "latest")


def _resolve(mapping, preset: str, rule: Rule) -> Query:
    def q(spark, sf):
        return resolve(mapping(spark, sf), SPEC, PRESETS[preset], rule)

    return q


def resolve_realloc(spark, sf):
    return resolve(m1_orders(spark, sf), SPEC, DEFAULT, Rule.FLAG)


def resolve_no_realloc(spark, sf):
    return resolve(m1_orders(spark, sf), SPEC, NONE, Rule.SOURCE)


def dedupe_flag_supplier(spark, sf):
    rows = latest_rows(m1_orders(spark, sf), SPEC, Rule.FLAG, DEFAULT)
    one = dedupe(rows, SPEC, priority=("source", ["apc", "ae", "op"]), order=["o_orderkey"])
    return one.select("entity", "o_orderkey", "latest")


def _m1_with_nulls(spark, sf):
    """M1 with the not-stated code turned into NULL (a source of NULL codes)."""
    m = m1_orders(spark, sf)
    return m.withColumn("category", F.when(F.col("category") != "Z", F.col("category")))


def prepare_drop_nulls(spark, sf):
    clean = prepare(_m1_with_nulls(spark, sf), SPEC)
    return clean.groupBy("entity", "category").agg(F.count(F.lit(1)).alias("n"))


def resolve_after_prepare(spark, sf):
    return resolve(_m1_with_nulls(spark, sf), SPEC, DEFAULT, Rule.SOURCE)


def policy_manifest(spark, sf):
    """The three manifest rows plus a row of records removed by ``prepare``,
    counted by Spark from the table."""
    return manifest(spark, "GP", DEFAULT, raw=_m1_with_nulls(spark, sf), spec=SPEC)


def modal_vs_latest_matrix(spark, sf):
    r = resolve(m1_orders(spark, sf), SPEC, DEFAULT, Rule.FLAG)
    return r.groupBy("modal", "latest").agg(F.count(F.lit(1)).alias("n"))


def _m1_hot(spark, sf):
    """M1 with one planted hot entity (-1) holding every third order."""
    m = m1_orders(spark, sf)
    return m.withColumn("entity", F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("entity")))


def top_tier_records(spark, sf):
    kept = keep_top_tier(m1_orders(spark, sf), SPEC, DEFAULT)
    return kept.select("o_orderkey", "entity", "category", "tier")


def modal_attached_no_realloc(spark, sf):
    return attach_modal(m1_orders(spark, sf), SPEC, NONE).select("o_orderkey", "entity", "modal")


def _latest_records(mapping, preset: str, rule: Rule, spec: ColumnSpec = SPEC) -> Query:
    def q(spark, sf):
        rows = latest_rows(mapping(spark, sf), spec, rule, PRESETS[preset])
        return rows.select("o_orderkey", "entity", "latest")

    return q


#: Rows of a task in the hot-key queries: small, so that the planted entity is split at any scale.
HOT_PIECE = 500


def modal_attached_hot(spark, sf):
    return attach_modal(_m1_hot(spark, sf), SPEC, DEFAULT, piece_rows=HOT_PIECE).select("o_orderkey", "entity", "modal")


def latest_flag_records_hot(spark, sf):
    rows = latest_rows(_m1_hot(spark, sf), SPEC, Rule.FLAG, DEFAULT, piece_rows=HOT_PIECE)
    return rows.select("o_orderkey", "entity", "latest")


def top_tier_hot(spark, sf):
    kept = keep_top_tier(_m1_hot(spark, sf), SPEC, DEFAULT, piece_rows=HOT_PIECE)
    return kept.select("o_orderkey", "entity", "category", "tier")


def modal_no_realloc_diag_hot(spark, sf):
    a = attach_modal(_m1_hot(spark, sf), SPEC, NONE, diagnostics=True, piece_rows=HOT_PIECE)
    return a.select("o_orderkey", "entity", "modal", "count_of_category", "max_count_of_category", "n_tied")


# ---- every code, NULL entities, codes, dates, sources and flags (M4)

#: A code in both lists is not valid.
BOTH_LISTS = TierPolicy("Both_lists", ("99", "Z"), ("Z", "S"))


def _tiers_all_codes(policy: TierPolicy) -> Query:
    def q(spark, sf):
        t = assign_tier(m4_all_codes(spark, sf), SPEC, policy, is_other="is_other")
        return t.groupBy("category", "tier", "is_other").agg(F.count(F.lit(1)).alias("n"))

    return q


def _attached_all_codes(preset: str) -> Query:
    def q(spark, sf):
        return attach_modal(m4_all_codes(spark, sf), SPEC, PRESETS[preset]).select("l_orderkey", "l_linenumber", "entity", "modal")

    return q


def top_tier_all_codes(spark, sf):
    kept = keep_top_tier(m4_all_codes(spark, sf), SPEC, PRESETS["all"], is_other="is_other")
    return kept.select("l_orderkey", "l_linenumber", "entity", "category", "tier", "is_other")


def _run(dataset: str, preset: str) -> Query:
    """The documented run: the latest records, each with its entity's modal value."""

    def q(spark, sf):
        latest = run(m4_all_codes(spark, sf), RunConfig(dataset, PRESETS[preset], SPEC))["latest"]
        record = ["l_orderkey", "l_linenumber"] if dataset == "GP" else []
        return latest.select(*record, "entity", "modal", "latest")

    return q


def latest_events_monthly(spark, sf):
    spec = ColumnSpec(date_grain="month")
    return latest_by_entity(m3_events(spark, sf), spec, Rule.NONE, DEFAULT)


def latest_source_diag(spark, sf):
    rows = latest_rows(m2_lineitem(spark, sf), SPEC, Rule.SOURCE, DEFAULT, diagnostics=True)
    return rows.select("entity", "latest", "tier", "n_codes", "max_date")


def modal_null_codes(spark, sf):
    """A2 with NULL codes left in (no clean-up): NULL is top tier, counts 0."""
    return modal_by_entity(_m1_with_nulls(spark, sf), SPEC, DEFAULT)


def _latest_null_codes(preset: str, rule: Rule) -> Query:
    def q(spark, sf):
        return latest_by_entity(_m1_with_nulls(spark, sf), SPEC, rule, PRESETS[preset])

    return q


def latest_record_no_realloc_source(spark, sf):
    rows = latest_rows(m1_orders(spark, sf), SPEC, Rule.SOURCE, NONE)
    return rows.select("entity", "o_orderkey", "latest")


def top_tier_records_null_codes(spark, sf):
    kept = keep_top_tier(_m1_with_nulls(spark, sf), SPEC, DEFAULT)
    return kept.select("o_orderkey", "entity", "category", "tier")


# ---- policy-free summaries (A6, A7, A8), order keys of other types (A3, A5)


def _policies_compared(mapping, rule: Rule) -> Query:
    """All six presets, both methods, from one scan."""

    def q(spark, sf):
        return compare_policies(prepare(mapping(spark, sf), SPEC), SPEC, list(PRESETS.values()), rule)

    return q


def _resolve_summary(preset: str, rule: Rule) -> Query:
    def q(spark, sf):
        summary = prepare(summarise(m4_all_codes(spark, sf), SPEC), SPEC)
        return resolve(summary, SPEC, PRESETS[preset], rule, weight=N_RECORDS)

    return q


def _batches(spark, sf) -> DataFrame:
    """M4 in three batches of orders, summarised one by one and merged."""
    rows = m4_all_codes(spark, sf)
    n_rows = rows.count()
    first, *others = [summarise(rows.where(F.col("l_orderkey") % 3 == k), SPEC, rows=n_rows) for k in range(3)]
    return merge_summaries(first, *others, spec=SPEC)


def resolve_merged_batches(spark, sf):
    return resolve(prepare(_batches(spark, sf), SPEC), SPEC, DEFAULT, Rule.FLAG, weight=N_RECORDS)


def merged_batch_counts(spark, sf):
    return prepare_counts(_batches(spark, sf), SPEC)


def _latest_text_dates(preset: str, rule: Rule) -> Query:
    def q(spark, sf):
        rows = m3_events(spark, sf).withColumn("observed_at", F.date_format("observed_at", "yyyy-MM-dd"))
        return latest_by_entity(rows, SPEC, rule, PRESETS[preset])

    return q


def _m4_nan_dates(spark, sf) -> DataFrame:
    """M4 with years as doubles, NaN on every fifth line."""
    date = F.when(F.col("l_linenumber") == 5, F.lit(float("nan"))).otherwise(F.col("observed_at").cast("double"))
    return m4_all_codes(spark, sf).withColumn("observed_at", date)


def _latest_nan_dates(preset: str, rule: Rule) -> Query:
    def q(spark, sf):
        return latest_by_entity(_m4_nan_dates(spark, sf), SPEC, rule, PRESETS[preset])

    return q


def read_by_name(spark, sf):
    """Modal over a table that is read by its name in the catalog."""
    m1_orders(spark, sf).createOrReplaceTempView("tierwise_orders_by_name")
    return modal_by_entity(read_input(spark, "tierwise_orders_by_name"), SPEC, DEFAULT)


def catalogue() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for p in PRESETS:
        q[f"tier_rows_{p}"] = _tier_rows(p)
    for p in PRESETS:
        q[f"top_tier_{p}"] = _top_tier(p)
    for p in REALLOC_PRESETS:
        q[f"modal_{p}"] = _modal(p)
    q["modal_small_groups"] = _modal(DEFAULT_PRESET, m2_lineitem)
    q["modal_attached"] = modal_attached
    q["modal_no_realloc"] = _modal("none")
    q["modal_no_realloc_diag"] = modal_no_realloc_diag
    for p in REALLOC_PRESETS:
        q[f"latest_{p}"] = _latest(p, Rule.NONE, m2_lineitem)
    q["latest_source"] = _latest(DEFAULT_PRESET, Rule.SOURCE, m2_lineitem)
    q["latest_flag"] = _latest(DEFAULT_PRESET, Rule.FLAG, m2_lineitem, count_rows=True, null_flags=True)
    q["latest_no_realloc"] = _latest("none", Rule.NONE, m2_lineitem)
    q["latest_no_realloc_source"] = _latest("none", Rule.SOURCE, m2_lineitem)
    q["latest_no_realloc_flag"] = _latest("none", Rule.FLAG, m2_lineitem, count_rows=True, null_flags=True)
    q["latest_events_daily"] = _latest(DEFAULT_PRESET, Rule.NONE, m3_events)
    q["latest_events_source"] = _latest(DEFAULT_PRESET, Rule.SOURCE, m3_events)
    q["latest_record_source"] = latest_record_source
    q["resolve_realloc"] = resolve_realloc
    q["resolve_no_realloc"] = resolve_no_realloc
    q["resolve_after_prepare"] = resolve_after_prepare
    q["dedupe_flag_supplier"] = dedupe_flag_supplier
    q["prepare_drop_nulls"] = prepare_drop_nulls
    q["policy_manifest"] = policy_manifest
    q["modal_vs_latest_matrix"] = modal_vs_latest_matrix
    q["top_tier_records"] = top_tier_records
    q["modal_attached_no_realloc"] = modal_attached_no_realloc
    q["latest_flag_records"] = _latest_records(m1_orders, DEFAULT_PRESET, Rule.FLAG)
    q["latest_no_realloc_flag_records"] = _latest_records(m1_orders, "none", Rule.FLAG)
    q["modal_events"] = _modal(DEFAULT_PRESET, m3_events)
    q["latest_events_flag"] = _latest(DEFAULT_PRESET, Rule.FLAG, m3_events, count_rows=True)
    q["latest_events_no_realloc"] = _latest("none", Rule.NONE, m3_events)
    q["latest_events_monthly"] = latest_events_monthly
    q["modal_attached_hot"] = modal_attached_hot
    q["latest_flag_records_hot"] = latest_flag_records_hot
    q["top_tier_hot"] = top_tier_hot
    q["modal_no_realloc_diag_hot"] = modal_no_realloc_diag_hot
    q["latest_source_diag"] = latest_source_diag
    q["modal_null_codes"] = modal_null_codes
    q["latest_record_no_realloc_source"] = latest_record_no_realloc_source
    q["top_tier_records_null_codes"] = top_tier_records_null_codes
    q["latest_null_codes_source"] = _latest_null_codes(DEFAULT_PRESET, Rule.SOURCE)
    q["latest_no_realloc_null_codes"] = _latest_null_codes("none", Rule.NONE)
    for rule in Rule:
        q[f"resolve_small_groups_{rule.value}"] = _resolve(m2_lineitem, DEFAULT_PRESET, rule)
        q[f"resolve_small_groups_no_realloc_{rule.value}"] = _resolve(m2_lineitem, "none", rule)
    for p in PRESETS:
        q[f"tiers_all_codes_{p}"] = _tiers_all_codes(PRESETS[p])
    q["tiers_both_lists"] = _tiers_all_codes(BOTH_LISTS)
    q["top_tier_all_codes"] = top_tier_all_codes
    for p in REALLOC_PRESETS:
        q[f"modal_all_codes_{p}"] = _modal(p, m4_all_codes)
        q[f"latest_all_codes_{p}"] = _latest(p, Rule.NONE, m4_all_codes)
    q["modal_all_codes_none"] = _modal("none", m4_all_codes)
    q["modal_attached_all_codes"] = _attached_all_codes(DEFAULT_PRESET)
    q["modal_attached_no_realloc_all_codes"] = _attached_all_codes("none")
    for rule in Rule:
        q[f"latest_no_realloc_all_codes_{rule.value}"] = _latest("none", rule, m4_all_codes)
        if rule is not Rule.NONE:
            q[f"latest_all_codes_rule_{rule.value}"] = _latest(DEFAULT_PRESET, rule, m4_all_codes)
    for dataset in ("GP", "HES", "IAPT"):
        q[f"run_{dataset.lower()}"] = _run(dataset, DEFAULT_PRESET)
        q[f"run_{dataset.lower()}_no_realloc"] = _run(dataset, "none")
    for rule in Rule:
        q[f"policies_compared_{rule.value}"] = _policies_compared(m4_all_codes, rule)
        q[f"resolve_summary_{rule.value}"] = _resolve_summary(DEFAULT_PRESET, rule)
        q[f"resolve_summary_no_realloc_{rule.value}"] = _resolve_summary("none", rule)
        q[f"latest_text_dates_{rule.value}"] = _latest_text_dates(DEFAULT_PRESET, rule)
        q[f"latest_nan_dates_{rule.value}"] = _latest_nan_dates(DEFAULT_PRESET, rule)
    q["policies_compared_orders"] = _policies_compared(m1_orders, Rule.FLAG)
    q["latest_text_dates_no_realloc"] = _latest_text_dates("none", Rule.SOURCE)
    q["latest_nan_dates_no_realloc"] = _latest_nan_dates("none", Rule.FLAG)
    q["resolve_merged_batches"] = resolve_merged_batches
    q["merged_batch_counts"] = merged_batch_counts
    q["read_by_name"] = read_by_name
    return q
