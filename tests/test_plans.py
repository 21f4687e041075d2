"""Plan shape: the properties that matter at scale, read from the physical plan."""

import re

import pytest

from scales import SF_SMALL
from tierwise import (PRESETS, ColumnSpec, Rule, attach_modal, compare_policies, keep_top_tier, latest_by_entity, latest_rows,
                      modal_by_entity, prepare, resolve, summarise)
from tierwise.sources.mappings import m1_orders, m2_lineitem

SPEC = ColumnSpec()
POL = PRESETS["unknown_not_stated_any_other"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(pattern, text):
    return len(re.findall(pattern, text))


@pytest.mark.parametrize("rule", list(Rule))
@pytest.mark.parametrize("realloc", [True, False])
def test_latest_is_one_shuffle_no_window(spark, rule, realloc):
    pol = POL if realloc else PRESETS["none"]
    p = plan(latest_by_entity(m2_lineitem(spark, SF_SMALL), SPEC, rule, pol))
    assert count(r"Exchange hashpartitioning", p) == 1
    assert count(r"Scan parquet", p) == 1
    assert "Window" not in p and "Union" not in p
    # partial aggregation before the shuffle
    assert "partial_max" in p


def test_modal_two_aggregated_shuffles(spark):
    p = plan(modal_by_entity(m1_orders(spark, SF_SMALL), SPEC, POL))
    assert count(r"Exchange hashpartitioning", p) == 2
    assert count(r"Scan parquet", p) == 1
    assert "partial_count" in p and "Window" not in p


def test_resolve_joins_summaries_without_extra_shuffle(spark):
    p = plan(resolve(m1_orders(spark, SF_SMALL), SPEC, POL, Rule.FLAG))
    # modal: (entity, code) then entity; latest: entity; the join reuses both
    assert count(r"Exchange hashpartitioning", p) == 3
    assert count(r"Scan parquet", p) == 2
    assert "Window" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_reads_only_needed_columns(spark):
    p = plan(modal_by_entity(m1_orders(spark, SF_SMALL), SPEC, POL))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert set(x.split(":")[0] for x in schema.split(",")) == {"o_custkey", "o_orderpriority"}


def test_entity_filter_reaches_scan(spark):
    df = m1_orders(spark, SF_SMALL).where("entity = 7")
    p = plan(modal_by_entity(df, SPEC, POL))
    assert re.search(r"PushedFilters: \[[^\]]*o_custkey", p)


def test_hot_key_table_is_broadcast_by_hint(spark):
    """The broadcast doesn't hang on Spark's own size estimate: the bounded table carries the hint."""
    df = latest_rows(m2_lineitem(spark, SF_SMALL), SPEC, Rule.FLAG, POL)
    assert "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    p = plan(df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


ROW_FORMS = {
    "top_tier": lambda df: keep_top_tier(df, SPEC, POL),
    "modal": lambda df: attach_modal(df, SPEC, POL),
    "modal_none": lambda df: attach_modal(df, SPEC, PRESETS["none"]),
    "flag": lambda df: latest_rows(df, SPEC, Rule.FLAG, POL),
}


@pytest.fixture
def static_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("form", ROW_FORMS)
def test_row_forms_read_the_input_twice(spark, static_plans, form):
    """Once for the per-entity summary, whose shuffle also counts the keys, and once for the rows;
    the top tier reads its settled rows, which no join moves, apart from the others."""
    p = plan(ROW_FORMS[form](m1_orders(spark, SF_SMALL)))
    assert count(r"FileScan parquet", p) == (3 if form == "top_tier" else 2), p


def test_settled_rows_are_not_shuffled(spark, static_plans):
    """Rows at the highest tier go from the scan to the result."""
    p = plan(keep_top_tier(m2_lineitem(spark, SF_SMALL), SPEC, POL))
    union = p[p.index("Union"):]
    branches = re.split(r"\n(?=\s*[:+]- )", union)
    settled = union.split("\n   :- ")[1].split("\n   +- ")[0] if "\n   :- " in union else branches[1]
    assert "Exchange" not in settled.split("+- *(")[0] and count("FileScan", union) == 3


def test_all_presets_from_one_scan(spark, static_plans):
    for rule in Rule:
        p = plan(compare_policies(m2_lineitem(spark, SF_SMALL), SPEC, list(PRESETS.values()), rule))
        # to the summary, to entity and category, to the entity: nothing moves once rows are repeated by policy
        assert count(r"FileScan parquet", p) == 1 and count(r"Exchange hashpartitioning", p) == 3
        assert "Join" not in p and "Window" not in p and "partial_count" in p


def test_summaries_have_fixed_width_buffers(spark, static_plans):
    p = plan(summarise(m2_lineitem(spark, SF_SMALL), SPEC))
    assert "SortAggregate" not in p and count("HashAggregate", p) == 2 and count(r"Exchange hashpartitioning", p) == 1


@pytest.mark.parametrize("form", ROW_FORMS)
def test_entity_filter_on_the_input_reaches_every_scan(spark, static_plans, form):
    """Filtering the input by entity is filtering the result, and reaches the scans."""
    m = m1_orders(spark, SF_SMALL)
    filtered = ROW_FORMS[form](m.where("entity = 7"))
    scans = re.findall(r"FileScan parquet[^\n]*", plan(filtered))
    assert scans and all(re.search(r"PushedFilters: \[[^\]]*o_custkey", s) for s in scans)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(filtered) == key(ROW_FORMS[form](m).where("entity = 7"))


@pytest.mark.parametrize("form, used", [
    ("top_tier", {"o_custkey", "o_orderpriority", "o_orderkey"}),
    ("modal", {"o_custkey", "o_orderpriority", "o_orderkey"}),
    ("flag", {"o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate", "o_totalprice"}),
])
def test_row_forms_read_only_used_columns(spark, static_plans, form, used):
    p = plan(ROW_FORMS[form](m1_orders(spark, SF_SMALL)).select("o_orderkey", "entity"))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", p):
        assert {x.split(":")[0] for x in schema.split(",")} <= used


@pytest.mark.parametrize("clean", [True, False])
def test_resolve_in_a_run_adds_no_shuffle(spark, static_plans, clean):
    m = m1_orders(spark, SF_SMALL)
    df = prepare(m, SPEC) if not clean else m
    p = plan(resolve(df, SPEC, POL, Rule.FLAG, clean=clean, no_null_entity=True))
    assert count(r"Exchange hashpartitioning", p) == 3
