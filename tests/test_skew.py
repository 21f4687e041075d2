"""A hot entity holding a third of all records: results unchanged, work split."""

import pytest
from pyspark.sql import functions as F

from scales import SF_ORACLE
from tierwise import PRESETS, ColumnSpec, Rule, attach_modal, keep_top_tier, latest_rows
from tierwise.plans.skew import hot_keys, split_join
from tierwise.sources.mappings import m1_orders

SPEC = ColumnSpec()
POL = PRESETS["unknown_not_stated_any_other"]
HOT = -1


@pytest.fixture(scope="module")
def skewed(spark):
    m = m1_orders(spark, SF_ORACLE)
    # one entity takes every third order; duplicates of its rows are kept
    return m.withColumn("entity", F.when(F.col("o_orderkey") % 3 == 0, F.lit(HOT)).otherwise(F.col("entity")))


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_hot_key_table_is_bounded(spark, skewed):
    hot = hot_keys(skewed, ["entity"], pieces=8, min_rows=1, null_safe=True).collect()
    # at most `pieces` keys can hold N/pieces rows; here only the planted one does
    assert [r["entity"] for r in hot] == [HOT]
    total = skewed.count()
    n_hot = skewed.where(F.col("entity") == HOT).count()
    assert n_hot * 3 >= total - 3
    assert hot[0]["__tw_pieces"] == -(-n_hot * 8 // total)
    # with large partitions (few pieces), pieces are capped at min_rows rows
    capped = hot_keys(skewed, ["entity"], pieces=3, min_rows=1, piece_rows=500, null_safe=True).collect()
    assert capped[0]["__tw_pieces"] == -(-n_hot // 500)


def test_split_join_spreads_hot_key(spark, skewed):
    summary = skewed.groupBy("entity").agg(F.max("category").alias("mx"))
    out = split_join(skewed, summary, ["entity"], how="left", null_safe=True, pieces=8, min_rows=1)
    # partition ids taken before the filter (a nondeterministic column keeps the
    # filter above the join); AQE must not merge the small test partitions
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tagged = out.withColumn("p", F.spark_partition_id())
        parts = {r["p"] for r in tagged.where(F.col("entity") == HOT).select("p").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(parts) >= 2, "hot entity should be spread over several join tasks"
    plain = skewed.join(summary, "entity", "left")
    cols = ["o_orderkey", "entity", "mx"]
    assert _rows(out, cols) == _rows(plain, cols)


def test_skewed_operators_match_unsplit(spark, skewed):
    split = {"pieces": 8, "min_rows": 1}
    never = {"pieces": 8, "min_rows": 10**12}
    a = attach_modal(skewed, SPEC, POL, **split)
    b = attach_modal(skewed, SPEC, POL, **never)
    assert _rows(a, ["o_orderkey", "modal"]) == _rows(b, ["o_orderkey", "modal"])
    a = keep_top_tier(skewed, SPEC, POL, **split)
    b = keep_top_tier(skewed, SPEC, POL, **never)
    assert _rows(a, ["o_orderkey"]) == _rows(b, ["o_orderkey"])
    a = latest_rows(skewed, SPEC, Rule.FLAG, POL, **split)
    b = latest_rows(skewed, SPEC, Rule.FLAG, POL, **never)
    assert _rows(a, ["o_orderkey", "latest"]) == _rows(b, ["o_orderkey", "latest"])
    assert a.where(F.col("entity") == HOT).count() > 1


def test_hot_null_entity(spark, skewed):
    """A third of the records with no entity: split as a group when NULLs are
    one group (no re-allocation), spread and given NULL otherwise."""
    nulls = skewed.withColumn("entity", F.when(F.col("entity") != HOT, F.col("entity")))
    split = {"pieces": 8, "min_rows": 1}
    never = {"pieces": 8, "min_rows": 10**12}
    a4 = attach_modal(nulls, SPEC, PRESETS["none"], **split)
    assert _rows(a4, ["o_orderkey", "modal"]) == _rows(attach_modal(nulls, SPEC, PRESETS["none"], **never), ["o_orderkey", "modal"])
    assert a4.where(F.col("entity").isNull() & F.col("modal").isNotNull()).count() > 0
    a2 = attach_modal(nulls, SPEC, POL, **split)
    assert a2.count() == nulls.count()
    assert a2.where(F.col("entity").isNull() & F.col("modal").isNotNull()).count() == 0
    # AQE would broadcast the small summary at this size (no row shuffle at
    # all); keep the sort-merge join that large inputs get
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (a4, a2):
            parts = {r["p"] for r in out.withColumn("p", F.spark_partition_id()).where(F.col("entity").isNull()).select("p").collect()}
            assert len(parts) >= 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keys_above_the_task_limit_are_split_whatever_the_partitions(spark):
    """200 of 1,000 rows on one key, 4 partitions: below N / P, above the rows of a task."""
    rows = spark.range(1000).select(F.when(F.col("id") < 200, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for p in ("4", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", p)
            hot = hot_keys(rows, ["k"], null_safe=True, piece_rows=10).collect()
            assert [(r["k"], r["__tw_pieces"]) for r in hot] == [(-1, 20)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert hot_keys(rows, ["k"], null_safe=True, piece_rows=201).collect() == []


def test_hot_key_table_never_passes_its_bound(spark, monkeypatch):
    import tierwise.plans.skew as skew

    rows = spark.range(5000).select((F.col("id") % 500).alias("k"))
    monkeypatch.setattr(skew, "MAX_HOT", 50)  # 500 keys of 10 rows: all below a 50th of the rows
    assert skew.hot_keys(rows, ["k"], null_safe=True, piece_rows=1).collect() == []
    monkeypatch.setattr(skew, "MAX_HOT", 600)
    assert len(skew.hot_keys(rows, ["k"], null_safe=True, piece_rows=1).collect()) == 500


def test_wide_rows_make_smaller_pieces(spark):
    from tierwise.plans.skew import row_width

    narrow = spark.range(1).select("id")
    wide = narrow.select("id", *[F.lit("x").alias(f"c{k}") for k in range(100)])
    assert row_width(narrow) == 8 and row_width(wide) == 8 + 100 * 64


def test_catalogue_hot_queries_split(spark):
    """The registered hot queries do exercise the split: their hot table is not empty."""
    from tierwise.plans import catalog

    hot = hot_keys(catalog._m1_hot(spark, SF_ORACLE), ["entity"], null_safe=True, piece_rows=catalog.HOT_PIECE).collect()
    assert [r["entity"] for r in hot] == [-1] and hot[0]["__tw_pieces"] >= 2


def test_result_names_must_be_new(spark, skewed):
    from tierwise import assign_tier

    for name, f in {
        "latest": lambda d: latest_rows(d, SPEC, Rule.FLAG, POL),
        "Latest": lambda d: latest_rows(d, SPEC, Rule.SOURCE, POL),
        "tier": lambda d: keep_top_tier(d, SPEC, POL),
        "TIER": lambda d: assign_tier(d, SPEC, POL),
        "modal": lambda d: attach_modal(d, SPEC, POL),
        "n_tied": lambda d: attach_modal(d, SPEC, PRESETS["none"], diagnostics=True),
    }.items():
        with pytest.raises(ValueError, match="already exist"):
            f(skewed.withColumn(name, F.lit(1)))


def test_column_names_ignore_case_as_spark_does(spark, skewed):
    upper = skewed.select([F.col(c).alias(c.upper()) for c in skewed.columns])
    a = keep_top_tier(upper, SPEC, POL)
    assert a.columns == [c.upper() for c in skewed.columns] + ["tier"]
    assert sorted(r["O_ORDERKEY"] for r in a.collect()) == sorted(r["o_orderkey"] for r in keep_top_tier(skewed, SPEC, POL).collect())
    assert latest_rows(upper, SPEC, Rule.FLAG, POL).count() == latest_rows(skewed, SPEC, Rule.FLAG, POL).count()
