"""Specs, validation, date types, runs, manifest and saving."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

import golden
from tierwise import (
    PRESETS,
    ColumnSpec,
    Rule,
    RunConfig,
    TierPolicy,
    check_no_sentinel,
    latest_by_entity,
    manifest,
    modal_by_entity,
    preset,
    run,
    save_run,
)

SPEC = ColumnSpec()
POLICY = PRESETS["unknown_not_stated_any_other"]


@pytest.fixture(scope="module")
def gdf(spark):
    return golden.frame(spark)


def test_presets_and_rules():
    assert preset("all").other == ("S", "G", "L", "P", "C")
    assert not PRESETS["none"].reallocate
    assert Rule.for_dataset("gp") is Rule.FLAG and Rule.for_dataset("HES") is Rule.SOURCE
    assert Rule.for_dataset("IAPT") is Rule.NONE
    with pytest.raises(ValueError):
        Rule.for_dataset("other")
    with pytest.raises(ValueError):
        preset("nope")
    assert RunConfig("GP").rule is Rule.FLAG
    with pytest.raises(ValueError):
        ColumnSpec(date_grain="week")


def test_validation(spark, gdf):
    with pytest.raises(ValueError):
        modal_by_entity(gdf.drop("category"), SPEC, POLICY)
    with pytest.raises(ValueError):
        modal_by_entity(gdf.withColumn("__tw_x", F.lit(1)), SPEC, POLICY)
    with pytest.raises(TypeError):
        latest_by_entity(gdf.withColumn("observed_at", F.create_map(F.lit(1), F.col("observed_at"))), SPEC, Rule.NONE, POLICY)
    with pytest.raises(TypeError):
        latest_by_entity(gdf.withColumn("category", F.lit(1)), SPEC, Rule.NONE, POLICY)
    with pytest.raises(TypeError):
        latest_by_entity(gdf.withColumn("observed_at", F.lit(1)), ColumnSpec(date_grain="day"), Rule.NONE, POLICY)


def test_tier_in_both_lists_is_not_valid(spark, gdf):
    pol = TierPolicy("t", not_valid=("A",), other=("A", "B"))
    got = {r["entity"]: r["modal"] for r in modal_by_entity(gdf, SPEC, pol).collect()}
    assert got["P03"] == "B"  # A is not valid, B is "other": B wins although A is more frequent


@pytest.mark.parametrize("cast", ["timestamp", "timestamp_ntz", "int_days"])
def test_date_types_agree(spark, gdf, cast):
    if cast == "int_days":
        other = gdf.withColumn("observed_at", F.datediff("observed_at", F.lit("2000-01-01")))
    else:
        other = gdf.withColumn("observed_at", F.col("observed_at").cast(cast))
    for rule in Rule:
        a = sorted(latest_by_entity(gdf, SPEC, rule, POLICY).collect(), key=str)
        b = sorted(latest_by_entity(other, SPEC, rule, POLICY).collect(), key=str)
        assert a == b


def test_date_grain(spark, gdf):
    # P20-like conflict spread over two days of one month: distinct days resolve,
    # a month grain turns them into a same-month conflict
    rows = spark.createDataFrame(
        [("Q", "A", dt.datetime(2020, 5, 1, 9)), ("Q", "B", dt.datetime(2020, 5, 2, 9))],
        "entity string, category string, observed_at timestamp",
    )
    raw = {r["latest"] for r in latest_by_entity(rows, SPEC, Rule.NONE, POLICY).collect()}
    month = {r["latest"] for r in latest_by_entity(rows, ColumnSpec(date_grain="month"), Rule.NONE, POLICY).collect()}
    day = {r["latest"] for r in latest_by_entity(rows, ColumnSpec(date_grain="day"), Rule.NONE, POLICY).collect()}
    assert raw == {"B"} and day == {"B"} and month == {"unresolved"}


def test_sentinel_check(spark, gdf):
    check_no_sentinel(gdf, SPEC)
    with pytest.raises(ValueError):
        check_no_sentinel(gdf.withColumn("category", F.lit("unresolved")), SPEC)


def test_manifest(spark):
    m = manifest(spark, "GP", POLICY).collect()
    assert [r["Name"] for r in m] == ["Not valid list", "Other list", "Name of run"]
    assert m[0]["Counts"] == "['99', 'X', '-1', '-3', 'Z']"
    assert m[1]["Counts"] == "['S']"
    assert {r["Reallocation"] for r in m} == {"Unknown_not_stated_and_any_other_reallocated"}
    assert all(r["Datasource"] == "GP" and r["Comments"] == "" for r in m)


def test_run_and_save(spark, gdf):
    out = run(gdf, RunConfig("GP", POLICY, SPEC))
    latest = out["latest"].collect()
    assert {"modal", "latest"} <= set(out["latest"].columns)
    by = {}
    for r in latest:
        by.setdefault(r["entity"], set()).add((r["modal"], r["latest"]))
    assert by["P03"] == {("A", "B")}
    assert by["P19"] == {("A", "A")}
    assert None not in by  # cleaned first
    base = tempfile.mkdtemp(prefix="tierwise-save-")
    written = save_run(out, base, POLICY.name)
    for name, path in written.items():
        assert os.path.isdir(path)
        back = spark.read.parquet(path)
        assert back.count() == out[name].count()


def test_nan_dates_are_latest(spark):
    """As for Spark's max: NaN is larger than every number."""
    df = spark.createDataFrame(
        [("Q", "A", 2020.0), ("Q", "B", float("nan")), ("R", "A", float("nan"))],
        "entity string, category string, observed_at double",
    )
    got = {(r["entity"], r["latest"]) for r in latest_by_entity(df, SPEC, Rule.NONE, POLICY).collect()}
    assert got == {("Q", "B"), ("R", "A")}


def test_boolean_flag_and_custom_source_order(spark, gdf):
    flagged = gdf.withColumn("flag", F.col("flag") == 1)
    a = {(r["entity"], r["latest"]) for r in latest_by_entity(gdf, SPEC, Rule.FLAG, POLICY).collect()}
    b = {(r["entity"], r["latest"]) for r in latest_by_entity(flagged, SPEC, Rule.FLAG, POLICY).collect()}
    assert a == b
    # op before apc: P05 (A from apc, B from op on one day) now settles to B
    spec = ColumnSpec(source_order=("op", "ae", "apc"))
    got = {r["entity"]: r["latest"] for r in latest_by_entity(gdf, spec, Rule.SOURCE, POLICY).collect()}
    assert got["P05"] == "B"


def test_decimal_dates(spark, gdf):
    dec = gdf.withColumn("observed_at", F.datediff("observed_at", F.lit("2000-01-01")).cast("decimal(12,2)"))
    a = sorted(latest_by_entity(gdf, SPEC, Rule.SOURCE, POLICY).collect(), key=str)
    b = sorted(latest_by_entity(dec, SPEC, Rule.SOURCE, POLICY).collect(), key=str)
    assert a == b


def test_ntz_keys_ignore_session_time_zone(spark):
    # 02:30 on 2021-03-14 does not exist in New York; as a wall-clock value it
    # must still order before 03:30 and never tie with it
    df = spark.sql(
        "select 'Q' as entity, 'A' as category, timestamp_ntz'2021-03-14 02:30:00' as observed_at "
        "union all select 'Q', 'B', timestamp_ntz'2021-03-14 03:30:00'"
    )
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = {r["latest"] for r in latest_by_entity(df, SPEC, Rule.NONE, POLICY).collect()}
            assert got == {"B"}, tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_command_line_run(spark, gdf):
    from tierwise.__main__ import main

    base = tempfile.mkdtemp(prefix="tierwise-cli-")
    src = os.path.join(base, "in.parquet")
    gdf.write.parquet(src)
    written = main(["--input", src, "--dataset", "HES", "--out", os.path.join(base, "out")])
    assert set(written) == {"latest", "resolved", "manifest", "summary"}
    res = {r["entity"]: (r["modal"], r["latest"]) for r in spark.read.parquet(written["resolved"]).collect()}
    assert res["P05"] == ("unresolved", "A")  # source rule settles the same-day conflict


def test_tie_break_and_custom_keys(spark, gdf):
    from tierwise import dedupe, latest_rows, read_input

    # P20 under the source rule: two identical-key records (rid 44, 45) give B
    default = {r["entity"]: r["rid"] for r in latest_rows(gdf, SPEC, Rule.SOURCE, POLICY).collect()}
    assert default["P20"] == 45  # highest (key, rid, ...) by default
    pri = gdf.withColumn("pri", -F.col("rid"))
    chosen = {r["entity"]: r["rid"] for r in latest_rows(pri, SPEC, Rule.SOURCE, POLICY, tie_break=["pri"]).collect()}
    assert chosen["P20"] == 44  # the tie-break column decides first
    # one record per (entity, source)
    per = dedupe(gdf, SPEC, keys=["entity", "source"], order=["rid"]).collect()
    assert len(per) == gdf.select("entity", "source").distinct().count()
    assert {r["rid"] for r in per if r["entity"] == "P20"} == {43, 44}
    # a catalog name reads through spark.read.table
    gdf.createOrReplaceTempView("golden_records")
    assert read_input(spark, "golden_records").count() == gdf.count()


def test_empty_and_all_null_inputs(spark, gdf):
    from tierwise import attach_modal, dedupe, keep_top_tier, latest_rows, resolve

    empty = gdf.limit(0)
    split = {"min_rows": 1, "pieces": 4}
    for rule in Rule:
        assert latest_rows(empty, SPEC, rule, POLICY, **split).count() == 0
        assert latest_by_entity(empty, SPEC, rule, POLICY).count() == 0
    assert attach_modal(empty, SPEC, POLICY, **split).count() == 0
    assert attach_modal(empty, SPEC, PRESETS["none"], diagnostics=True, **split).count() == 0
    assert keep_top_tier(empty, SPEC, POLICY, **split).count() == 0
    assert dedupe(empty, SPEC).count() == 0
    assert resolve(empty, SPEC, POLICY, Rule.FLAG).count() == 0
    nulls = gdf.withColumn("category", F.lit(None).cast("string"))
    m = {r["entity"]: r["modal"] for r in modal_by_entity(nulls, SPEC, POLICY).collect()}
    assert set(m.values()) == {None}
    assert {r["latest"] for r in latest_by_entity(nulls, SPEC, Rule.SOURCE, POLICY).collect()} == {None}
    assert latest_by_entity(nulls, SPEC, Rule.NONE, PRESETS["none"]).count() == 0
    assert attach_modal(nulls, SPEC, POLICY, **split).count() == gdf.count()


def test_run_and_save_matches_run(spark, gdf):
    from tierwise import run_and_save

    base = tempfile.mkdtemp(prefix="tierwise-run-")
    cfg = RunConfig("GP", POLICY, SPEC)
    written = run_and_save(gdf, cfg, base)
    lazy = run(gdf, cfg)
    for name in ("resolved", "latest", "manifest"):
        got = sorted(map(str, spark.read.parquet(written[name]).select(*lazy[name].columns).collect()))
        assert got == sorted(map(str, lazy[name].collect())), name


def test_entity_column_named_like_internal_keys(spark, gdf):
    from tierwise import latest_rows

    spec = ColumnSpec(entity="n")
    renamed = gdf.withColumnRenamed("entity", "n")
    a = sorted((r["entity"], r["latest"]) for r in latest_rows(gdf, SPEC, Rule.FLAG, POLICY, min_rows=1).collect()
               if r["entity"] is not None)
    b = sorted((r["n"], r["latest"]) for r in latest_rows(renamed, spec, Rule.FLAG, POLICY, min_rows=1).collect()
               if r["n"] is not None)
    assert a == b


def _sorted(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("dataset", ["GP", "HES", "IAPT"])
def test_appending_runs_adds_each_run_once(spark, gdf, dataset):
    from tierwise import run_and_save

    base = tempfile.mkdtemp(prefix="tierwise-append-")
    cfg = RunConfig(dataset, POLICY, SPEC)
    once = run(gdf, cfg)
    written = run_and_save(gdf, cfg, base, mode="append")
    assert run_and_save(gdf, cfg, base, mode="append") == written
    for name in ("resolved", "latest", "manifest"):
        columns = once[name].columns
        twice = _sorted(spark.read.parquet(written[name]).select(*columns))
        assert twice == sorted(2 * _sorted(once[name])), name


def test_modes_that_could_mix_runs(spark, gdf):
    from tierwise import run_and_save
    from tierwise.__main__ import main

    base = tempfile.mkdtemp(prefix="tierwise-modes-")
    cfg = RunConfig("GP", POLICY, SPEC)
    with pytest.raises(ValueError, match="ignore"):
        run_and_save(gdf, cfg, base, mode="ignore")
    with pytest.raises(SystemExit):
        main(["--input", "x", "--dataset", "GP", "--out", base, "--mode", "ignore"])
    written = run_and_save(gdf, cfg, base, mode="errorifexists")
    before = _sorted(spark.read.parquet(written["latest"]))
    with pytest.raises(Exception, match="already exists"):
        run_and_save(gdf.limit(3), cfg, base, mode="errorifexists")
    assert _sorted(spark.read.parquet(written["latest"])) == before
    again = run_and_save(gdf, cfg, base, mode="overwrite")
    assert _sorted(spark.read.parquet(again["latest"])) == before


def test_run_to_tables_with_edited_lists_and_dedupe(spark, gdf):
    from tierwise.__main__ import main

    base = tempfile.mkdtemp(prefix="tierwise-cli-")
    src = os.path.join(base, "in.parquet")
    gdf.write.parquet(src)
    prefix = "twtest_" + os.path.basename(base).replace("-", "_")
    with pytest.raises(SystemExit):
        main(["--input", src, "--dataset", "GP", "--out", prefix, "--not-valid", "99"])
    written = main(["--input", src, "--dataset", "GP", "--out", prefix, "--not-valid", "99, X", "--other", "", "--run-name", "My run", "--dedupe"])
    assert written["latest"] == f"{prefix}_My_run_latest"
    latest = spark.read.table(written["latest"])
    assert latest.count() == latest.select("entity").distinct().count()
    manifest_rows = {r["Name"]: r["Counts"] for r in spark.read.table(written["manifest"]).collect()}
    assert manifest_rows["Not valid list"] == "['99', 'X']" and manifest_rows["Other list"] == "[]"
    for name in written.values():
        spark.sql(f"DROP TABLE {name}")


def test_other_codes_can_be_marked(spark, gdf):
    from tierwise import assign_tier
    from tierwise.plans import compat

    rows = assign_tier(gdf, SPEC, POLICY, is_other="is_other").collect()
    assert all(r["is_other"] == (r["category"] in POLICY.other) for r in rows)
    marked = compat.initial_clean(gdf, "category", "entity", ["S"], ["99"], is_other=True)
    assert {"ethnicity_hierarchy", "is_other"} <= set(marked.columns)
