"""Operators against the brute-force model on random data with NULLs everywhere."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import model
from tierwise import (
    PRESETS,
    ColumnSpec,
    Rule,
    TierPolicy,
    attach_modal,
    keep_top_tier,
    latest_by_entity,
    latest_rows,
    modal_by_entity,
    resolve,
)

SPEC = ColumnSpec()
SCHEMA = T.StructType(
    [
        T.StructField("rid", T.LongType()),
        T.StructField("entity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("observed_at", T.DateType()),
        T.StructField("source", T.StringType()),
        T.StructField("flag", T.IntegerType()),
    ]
)


def _data(seed, n_rows=6000, n_entities=1000):
    rnd = random.Random(seed)
    codes = ["A", "B", "S", "G", "Z", "99", "X", None]
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(5)] + [None]
    rows = []
    for i in range(n_rows):
        e = None if rnd.random() < 0.01 else f"e{rnd.randrange(n_entities)}"
        rows.append(
            (
                i,
                e,
                rnd.choice(codes) if rnd.random() < 0.9 else None,
                rnd.choice(days),
                rnd.choice(["apc", "ae", "op", "oth", None]),
                rnd.choice([0, 1, 2, None]),
            )
        )
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = _data(7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    recs = [dict(zip(SCHEMA.names, r)) for r in rows]
    return df, model.group(recs)


POLICIES = ["unknown_any_other", "unknown_not_stated", "all"]


@pytest.mark.parametrize("preset", POLICIES + ["none"])
def test_modal_by_entity(data, preset):
    df, groups = data
    pol = PRESETS[preset]
    got = {r["entity"]: r["modal"] for r in modal_by_entity(df, SPEC, pol).collect()}
    if pol.reallocate:
        exp = {e: model.modal(model.top_rows(rs, pol.not_valid, pol.other)) for e, rs in groups.items()}
    else:
        exp = {e: model.modal(rs) for e, rs in groups.items()}
    assert got == exp


@pytest.mark.parametrize("preset", POLICIES)
def test_keep_top_tier(data, preset):
    df, groups = data
    pol = PRESETS[preset]
    got = sorted(r["rid"] for r in keep_top_tier(df, SPEC, pol, min_rows=1, pieces=4).collect())
    exp = sorted(r["rid"] for rs in groups.values() for r in model.top_rows(rs, pol.not_valid, pol.other))
    assert got == exp


@pytest.mark.parametrize("rule", ["none", "source", "flag"])
@pytest.mark.parametrize("preset", POLICIES + ["none"])
def test_latest(data, rule, preset):
    df, groups = data
    pol = PRESETS[preset]
    out = latest_rows(df, SPEC, Rule(rule), pol, min_rows=1, pieces=4).collect()
    exp_rows = []
    for e, rs in groups.items():
        if pol.reallocate:
            exp_rows += [(r["rid"], e, v) for r, v in model.latest_realloc(rs, rule, pol.not_valid, pol.other)]
        else:
            exp_rows += [(r["rid"], e, v) for r, v in model.latest_plain(rs, rule)]
    if rule == "flag":  # every record at the best key, not de-duplicated
        assert sorted((r["rid"], r["entity"], r["latest"]) for r in out) == sorted(
            exp_rows, key=lambda x: (x[0],)
        )
    else:  # one record per (entity, value), which must be one of the kept records
        got = Counter((r["entity"], r["latest"]) for r in out)
        assert all(n == 1 for n in got.values())
        assert set(got) == {(e, v) for _, e, v in exp_rows}
        allowed = {(e, v): set() for _, e, v in exp_rows}
        for rid, e, v in exp_rows:
            allowed[(e, v)].add(rid)
        for r in out:
            assert r["rid"] in allowed[(r["entity"], r["latest"])]
    pairs = {(r["entity"], r["latest"]) for r in latest_by_entity(df, SPEC, Rule(rule), pol).collect()}
    assert pairs == {(e, v) for _, e, v in exp_rows}


def test_properties(spark, data):
    df, groups = data
    pol = PRESETS["unknown_not_stated_any_other"]
    # (a) row order does not matter; (b) doubling rows leaves modal unchanged
    a = {r["entity"]: r["modal"] for r in modal_by_entity(df.orderBy(F.rand(3)), SPEC, pol).collect()}
    b = {r["entity"]: r["modal"] for r in modal_by_entity(df.unionAll(df), SPEC, pol).collect()}
    c = {r["entity"]: r["modal"] for r in modal_by_entity(df, SPEC, pol).collect()}
    assert a == b == c
    # (c) the none policy gives the same modal with or without the re-allocation form
    nk = df.where(F.col("entity").isNotNull())
    empty = PRESETS["none"]
    x = attach_modal(nk, SPEC, empty, reallocate=True).select("rid", "modal")
    y = attach_modal(nk, SPEC, empty, reallocate=False).select("rid", "modal")
    assert sorted(x.collect()) == sorted(y.collect())
    # (f) row-preserving modal keeps every record
    assert attach_modal(df, SPEC, pol).count() == df.count()
    # (g) non-flag latest: at most one record per entity when codes are non-NULL
    clean = df.where(F.col("category").isNotNull())
    per = latest_rows(clean, SPEC, Rule.SOURCE, pol).groupBy("entity").count()
    assert per.where("count > 1").count() == 0
    # (h) re-allocation never loses an entity
    assert keep_top_tier(df, SPEC, pol).select("entity").distinct().count() == df.select("entity").distinct().count()
    # (e) adding a not-valid record to an entity with a valid one changes nothing
    extra = df.where(F.col("category") == "A").select(
        (F.col("rid") + 100000).alias("rid"), "entity", F.lit("99").alias("category"),
        F.lit(dt.date(2030, 1, 1)).alias("observed_at"), F.lit("apc").alias("source"), F.lit(1).alias("flag"),
    )
    before = {(r["entity"], r["modal"], r["latest"]) for r in resolve(df, SPEC, pol, Rule.NONE).collect()}
    after = {(r["entity"], r["modal"], r["latest"]) for r in resolve(df.unionByName(extra), SPEC, pol, Rule.NONE).collect()}
    assert before == after


@pytest.mark.parametrize("split", [{}, {"min_rows": 1, "pieces": 4}])
def test_modal_diagnostics(data, split):
    df, groups = data
    got = attach_modal(df, SPEC, PRESETS["none"], diagnostics=True, **split).collect()
    assert len(got) == df.count()
    for r in got:
        rs = groups[r["entity"]]
        counts = Counter(x["category"] for x in rs if x["category"] is not None)
        mx = max(counts.values()) if counts else 0
        assert r["count_of_category"] == counts.get(r["category"], 0)
        assert r["max_count_of_category"] == mx
        assert r["n_tied"] == sum(1 for v in counts.values() if v == mx)
        assert r["modal"] == model.modal(rs)


def test_records_do_not_depend_on_partitioning(spark, data):
    from tierwise import dedupe

    df, _ = data
    pol = PRESETS["all"]

    def snap(d):
        out = [sorted(map(str, latest_rows(d, SPEC, r, pol, min_rows=1, pieces=3).collect())) for r in Rule]
        out.append(sorted(map(str, dedupe(d, SPEC, priority=("source", ["ae"]), order=["flag"]).collect())))
        return out

    first = snap(df)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        second = snap(df.repartition(2).orderBy(F.rand(5)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert first == second


@pytest.mark.parametrize("rule", list(Rule))
def test_one_code_entities_agree(data, rule):
    """Property (d): with one non-NULL code over all its records, an entity
    gets the same value from both latest forms whenever both give one."""
    df, groups = data
    one = {e for e, rs in groups.items() if len({r["category"] for r in rs if r["category"] is not None}) == 1}
    pol = PRESETS["unknown_not_stated_any_other"]
    a3, a5 = {}, {}
    for r in latest_by_entity(df, SPEC, rule, pol).collect():
        if r["latest"] is not None:
            a3.setdefault(r["entity"], set()).add(r["latest"])
    for r in latest_by_entity(df, SPEC, rule, PRESETS["none"]).collect():
        a5.setdefault(r["entity"], set()).add(r["latest"])
    both = [e for e in one if e in a3 and e in a5]
    assert both
    for e in both:
        assert a3[e] == a5[e] and len(a3[e]) == 1


@pytest.mark.parametrize(
    "policy",
    [TierPolicy("only_other", (), ("S", "G")), TierPolicy("overlap", ("Z", "S"), ("S", "A"))],
    ids=["only_other", "overlap"],
)
def test_custom_policies(data, policy):
    df, groups = data
    got = {r["entity"]: r["modal"] for r in modal_by_entity(df, SPEC, policy).collect()}
    assert got == {e: model.modal(model.top_rows(rs, policy.not_valid, policy.other)) for e, rs in groups.items()}
    pairs = {(r["entity"], r["latest"]) for r in latest_by_entity(df, SPEC, Rule.SOURCE, policy).collect()}
    exp = {(e, v) for e, rs in groups.items() for _, v in model.latest_realloc(rs, "source", policy.not_valid, policy.other)}
    assert pairs == exp
