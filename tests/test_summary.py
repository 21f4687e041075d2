"""Policy-free summaries, merged state, order keys of any type, total order of records."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import tierwise.plans.skew as skew
from scales import SF_SMALL
from tierwise import (N_RECORDS, PRESETS, ColumnSpec, Rule, RunConfig, SummaryState, TierPolicy, compare_policies, dedupe, keep_top_tier,
                      latest_by_entity, latest_rows, merge_summaries, modal_by_entity, prepare, prepare_counts, resolve, run_and_save, summarise)
from tierwise.functions.keys import complement
from tierwise.plans import compat
from tierwise.sources.mappings import m1_orders, m4_all_codes

SPEC = ColumnSpec()
POLICY = PRESETS["unknown_not_stated_any_other"]
rows_of = lambda df: sorted(map(str, df.collect()))


def records(spark, n=3000, seed=1):
    """Records with NULLs in every column, few values, many ties."""
    draw = random.Random(seed)
    pick = draw.choice
    codes = ["99", "X", "Z", "S", "A", "B", "G", None, "historic"]
    rows = [(k, pick([None, *range(n // 12)]), pick(codes), pick([None, 2018, 2019, 2020]), pick(["apc", "ae", "op", "oth", None]), pick([None, 0, 1, 5])) for k in range(n)]
    return spark.createDataFrame(rows, "id int, entity int, category string, observed_at int, source string, flag int")


@pytest.mark.parametrize("rule", list(Rule))
@pytest.mark.parametrize("preset", PRESETS)
def test_summary_stands_for_its_records(spark, rule, preset):
    df, policy = records(spark).cache(), PRESETS[preset]
    summary = summarise(df, SPEC)
    assert rows_of(latest_by_entity(summary, SPEC, rule, policy)) == rows_of(latest_by_entity(df, SPEC, rule, policy))
    assert rows_of(modal_by_entity(summary, SPEC, policy, weight=N_RECORDS)) == rows_of(modal_by_entity(df, SPEC, policy))
    assert rows_of(resolve(summary, SPEC, policy, rule, weight=N_RECORDS)) == rows_of(resolve(df, SPEC, policy, rule))


@pytest.mark.parametrize("rule", list(Rule))
@pytest.mark.parametrize("clean", [True, False])
def test_all_policies_at_once(spark, rule, clean):
    df = records(spark, seed=2)
    df = (prepare(df, SPEC) if clean else df).cache()
    policies = [*PRESETS.values(), TierPolicy("both", ("99", "Z"), ("Z", "S"))]
    got = {(r.entity, r.policy): (r.modal, r.latest) for r in compare_policies(df, SPEC, policies, rule).collect()}
    for p in policies:
        expected = {(r.entity, p.name): (r.modal, r.latest) for r in resolve(df, SPEC, p, rule, clean=False).collect()}
        assert {k: v for k, v in got.items() if k[1] == p.name} == expected
    assert rows_of(compare_policies(summarise(df, SPEC), SPEC, policies, rule)) == rows_of(compare_policies(df, SPEC, policies, rule))
    with pytest.raises(ValueError):
        compare_policies(df, SPEC, [POLICY, POLICY], rule)


def test_merging_is_summarising_all(spark):
    df = records(spark, seed=3).cache()
    parts = [summarise(df.where(F.col("id") % 4 == k), SPEC) for k in range(4)]
    whole = rows_of(summarise(df, SPEC))
    for order in itertools.islice(itertools.permutations(parts), 3):
        assert rows_of(merge_summaries(*order, spec=SPEC)) == whole
    assert rows_of(merge_summaries(merge_summaries(*parts[:2], spec=SPEC), merge_summaries(*parts[2:], spec=SPEC), spec=SPEC)) == whole
    with pytest.raises(ValueError):
        merge_summaries(parts[0], parts[1].drop("flag"), spec=SPEC)
    n = prepare_counts(summarise(df, SPEC), SPEC).first()
    assert (n.n_records, n.n_removed) == (df.count(), df.where("entity IS NULL OR category IS NULL").count()) and n.n_sentinel == 0
    none = prepare_counts(summarise(df.limit(0), SPEC), SPEC).first()
    assert tuple(none) == (0, 0, 0)


def test_state_takes_batches(spark, tmp_path):
    df = records(spark, seed=4).cache()
    state = SummaryState(spark, f"{tmp_path}/state", SPEC)
    for k in range(3):
        state.put(df.where(F.col("id") % 3 == k), f"2024-0{k + 1}")
    state.put(df.where("id % 3 = 1"), "2024-02")  # a retried batch counts once
    assert state.batches() == ["2024-01", "2024-02", "2024-03"]
    assert rows_of(state.summary()) == rows_of(summarise(df, SPEC))
    for policy, rule in ((POLICY, Rule.FLAG), (PRESETS["none"], Rule.SOURCE)):
        assert rows_of(state.resolve(policy, rule)) == rows_of(resolve(df, SPEC, policy, rule))
    one = state.compacted(f"{tmp_path}/compact", "all")
    assert one.batches() == ["all"] and rows_of(one.summary()) == rows_of(state.summary())
    assert state.counts().first()[N_RECORDS] == df.count()
    with pytest.raises(ValueError):
        state.put(df, "a/b")


def test_summaries_without_source_and_flag(spark):
    df = records(spark).drop("source", "flag")
    assert summarise(df, SPEC).columns == ["entity", "category", "observed_at", N_RECORDS]
    assert rows_of(resolve(summarise(df, SPEC), SPEC, POLICY, Rule.NONE, weight=N_RECORDS)) == rows_of(resolve(df, SPEC, POLICY, Rule.NONE))


@pytest.mark.parametrize("dataset", ["GP", "HES", "IAPT"])
def test_a_run_reads_its_records_twice(spark, tmp_path, dataset):
    """Once for the summary, which also says what prepare removed, and once for the latest records."""
    df = records(spark, 1000)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    written = run_and_save(df.mapInArrow(count, df.schema), RunConfig(dataset, POLICY, SPEC), f"{tmp_path}/out")
    assert seen.value == 2 * 1000
    removed = {r.Name: r.Counts for r in spark.read.parquet(written["manifest"]).collect()}["Rows removed by prepare"]
    assert removed == str(df.where("entity IS NULL OR category IS NULL").count())


# --------------------------------------------------------- order keys of any type

KINDS = {
    "text": lambda: F.when(F.col("observed_at").isNotNull(), F.format_string("%05d", "observed_at")),
    "binary": lambda: F.when(F.col("observed_at").isNotNull(), F.encode(F.format_string("%05d", "observed_at"), "UTF-8")),
    "long": lambda: F.col("observed_at").cast("long"),
    "double": lambda: F.col("observed_at").cast("double"),
    "nan": lambda: F.when(F.col("observed_at") == 2020, F.lit(float("nan"))).otherwise(F.col("observed_at").cast("double")),
    "ntz": lambda: F.make_timestamp_ntz("observed_at", F.lit(3), F.lit(31), F.lit(2), F.lit(30), F.lit(0.5)),
    "timestamp": lambda: F.make_timestamp("observed_at", F.lit(3), F.lit(31), F.lit(2), F.lit(30), F.lit(0.5)),
    "months": lambda: F.make_ym_interval("observed_at", F.lit(2)),
    "days": lambda: F.make_dt_interval("observed_at", F.lit(1)),
    "struct": lambda: F.when(F.col("observed_at").isNotNull(), F.struct((F.col("observed_at") - 2000).alias("y"), F.lit("x").alias("z"))),
    "array": lambda: F.when(F.col("observed_at").isNotNull(), F.array((F.col("observed_at") - 2000))),
    "boolean": lambda: F.col("observed_at") == 2020,
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("rule", list(Rule))
def test_dates_of_any_type(spark, kind, rule):
    df = records(spark, 1500, seed=5)
    if kind == "boolean":
        df = df.withColumn("observed_at", F.when(F.col("observed_at") == 2018, 2019).otherwise(F.col("observed_at")))
    df = df.cache()
    other = df.withColumn("observed_at", KINDS[kind]())
    for policy in (POLICY, PRESETS["none"]):
        assert rows_of(latest_by_entity(other, SPEC, rule, policy)) == rows_of(latest_by_entity(df, SPEC, rule, policy))
        ids = lambda d: rows_of(latest_rows(d, SPEC, rule, policy, tie_break=["id"]).select("id", "entity", "latest"))
        assert ids(other) == ids(df)


def test_complements_order_the_other_way_round(spark):
    texts = ["", "a", "ab", "a\0", "a\0b", "b", "B", "é", "日本", "\uffff", "😀", "99", "-1"]
    df = spark.createDataFrame([(t,) for t in texts], "c string").select("c", complement(F.col("c")).alias("k"))
    ascending = [r.c for r in df.orderBy("c").collect()]
    assert [r.c for r in df.orderBy(F.col("k").desc()).collect()] == ascending == sorted(texts, key=str.encode)


def test_records_that_differ_in_a_map_only(spark):
    """One of them is chosen, the same whatever the order of rows and of map entries."""
    schema = "entity string, category string, observed_at int, m map<string,array<int>>, s struct<n:int,v:map<int,string>>"
    maps = [{"a": [1], "b": [2]}, {"b": [1], "a": [2]}, {"a": [1]}, None, {}]
    rows = [("E", "A", 2020, m, (k % 2, {1: "x", k: "y"})) for k, m in enumerate(maps)]
    chosen, firsts = set(), set()
    for order in itertools.islice(itertools.permutations(rows), 0, 120, 17):
        turned = [(*r[:3], dict(reversed(r[3].items())) if r[3] else r[3], r[4]) for r in order]
        for some in (list(order), turned):
            df = spark.createDataFrame(some, schema).repartition(3)
            chosen |= {str((sorted((r.m or {}).items()), r.m is None, r.s)) for r in latest_rows(df, SPEC, Rule.NONE, POLICY).collect()}
            firsts |= {str((sorted((r.m or {}).items()), r.m is None, r.s)) for r in dedupe(df, SPEC).collect()}
    assert len(chosen) == 1 and len(firsts) == 1


def test_helper_columns_of_the_call_compatible_functions(spark):
    df = m1_orders(spark, SF_SMALL).withColumnRenamed("source", "table").withColumnRenamed("flag", "ethnicity_code_present")
    out, counts = compat.get_latest_ethnicity(df, "observed_at", "entity", "category", "HES", [], ["99"], ["S"], helper_columns=True)
    assert {"max_date", "tier", "n_codes", "source_rank"} <= set(out.columns) and counts == []
    out = compat.get_latest_ethnicity_no_reallocation(df, "observed_at", "entity", "category", "GP", helper_columns=True)
    assert "max_date" in out.columns and out.where("observed_at <> max_date").count() == 0


# ------------------------------------------------------------ tiers and hot keys


@pytest.mark.parametrize("preset", [p for p in PRESETS])
def test_settled_rows_and_the_others(spark, preset):
    df = m4_all_codes(spark, SF_SMALL).cache()
    policy = PRESETS[preset]
    kept = keep_top_tier(df, SPEC, policy)
    tier = lambda code: 0 if code in policy.not_valid else (1 if code in policy.other else 2) if policy.other else 1
    best = {}
    rows = df.collect()
    for r in rows:
        best[r.entity] = max(best.get(r.entity, 0), tier(r.category))
    assert sorted((r.l_orderkey, r.l_linenumber, r.tier) for r in kept.collect()) == sorted(
        (r.l_orderkey, r.l_linenumber, tier(r.category)) for r in rows if tier(r.category) == best[r.entity]
    )


def test_pieces_follow_the_width_of_rows(spark, tmp_path, monkeypatch):
    """A key of long texts is cut into pieces of bytes, not of rows as narrow as the schema suggests."""
    monkeypatch.setattr(skew, "PIECE_BYTES", 1 << 20)
    wide = spark.range(400).select((F.col("id") % 2).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("s"))
    wide = wide.select("k", F.concat(*[F.sha2(F.concat("s", F.lit(str(j))), 512) for j in range(80)]).alias("text"))  # 10 KB a row
    wide.write.parquet(f"{tmp_path}/wide")
    wide.select("k", F.lit("short").alias("text")).write.parquet(f"{tmp_path}/narrow")
    pieces = {n: [r[skew.PIECES] for r in skew.hot_keys(spark.read.parquet(f"{tmp_path}/{n}"), ["k"], null_safe=True).collect()] for n in ("wide", "narrow")}
    assert len(pieces["wide"]) == 2 and all(2 <= p <= 8 for p in pieces["wide"]) and pieces["narrow"] == []


def test_tasks_of_summaries_take_bounded_rows(spark, monkeypatch):
    """Tasks grow in number with the rows, where partitions by compressed bytes would be few."""
    from tierwise.operators import summary

    monkeypatch.setattr(summary, "TASK_ROWS", 50)
    df = records(spark, 3000, seed=9).cache()
    assert summarise(df, SPEC).rdd.getNumPartitions() >= 60
    parts = [summarise(df.where(F.col("id") % 3 == k), SPEC, rows=3000) for k in range(3)]
    merged = merge_summaries(*parts, spec=SPEC)
    assert merged.rdd.getNumPartitions() >= 60 and rows_of(merged) == rows_of(summarise(df, SPEC))
    for rule in Rule:
        assert compare_policies(df, SPEC, list(PRESETS.values()), rule).rdd.getNumPartitions() >= 60


def test_tasks_take_few_of_the_repeated_rows(spark, monkeypatch):
    from tierwise.operators import summary

    monkeypatch.setattr(summary, "TASK_ROWS", 50)
    df = records(spark, 1000, seed=9).cache()
    for rule in Rule:
        assert compare_policies(df, SPEC, list(PRESETS.values()), rule).rdd.getNumPartitions() >= 1000 // 50 * len(PRESETS)
