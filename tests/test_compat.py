"""Call-compatible entry points give the same results as the operators."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import golden
from tierwise.plans import compat

NV = ["99", "X", "-1", "-3", "Z"]
OT = ["S"]


@pytest.fixture(scope="module")
def gp(spark):
    # the original's column names: person, code, date, source table, flag
    return golden.frame(spark).select(
        "rid",
        F.col("entity").alias("nhs_number"),
        F.col("category").alias("ethnic"),
        F.col("observed_at").alias("date_of_journal_item"),
        F.col("source").alias("table"),
        F.col("flag").alias("ethnicity_code_present"),
    )


def test_initial_clean(gp):
    out = compat.initial_clean(gp, "ethnic", "nhs_number", OT, NV)
    assert "ethnicity_hierarchy" in out.columns
    by = {}
    for r in out.collect():
        by.setdefault(r["nhs_number"], set()).add(r["ethnic"])
    assert by["P06"] == {"A"} and by["P08"] == {"S"} and by["P09"] == {"Z", "99"}


def test_modal_pair(gp):
    out, counts = compat.get_modal_ethnicity(gp, "nhs_number", "ethnic", "GP", ["x"], NV, OT)
    assert counts == ["x"] and out.count() == gp.count()
    exp = golden.expected("A2")
    for r in out.collect():
        assert r["modal_ethnicity"] == (None if r["nhs_number"] is None else exp[r["nhs_number"]])


@pytest.mark.parametrize("dataset,col", [("IAPT", "A3_NONE"), ("HES", "A3_SOURCE"), ("GP", "A3_FLAG")])
def test_latest_pair(gp, dataset, col):
    out, _ = compat.get_latest_ethnicity(gp, "date_of_journal_item", "nhs_number", "ethnic", dataset, [], NV, OT)
    got = Counter((r["nhs_number"], r["latest_ethnicity"]) for r in out.collect())
    exp = {}
    for e, v in golden.expected(col).items():
        if v == golden.ABSENT:
            continue
        v, n = (v.split("*")[0], int(v.split("*")[1])) if isinstance(v, str) and "*" in v else (v, 1)
        exp[(e, v)] = n
    assert dict(got) == exp


def test_no_reallocation(gp):
    m = compat.get_modal_ethnicity_no_reallocation(gp, "nhs_number", "ethnic", "GP")
    assert {"count_of_ethnicity", "max_count_of_ethnicity", "multiple_max_ethnicities", "modal_ethnicity"} <= set(m.columns)
    assert {r["nhs_number"]: r["modal_ethnicity"] for r in m.collect()} == golden.expected("A4")
    out = compat.get_latest_ethnicity_no_reallocation(gp, "date_of_journal_item", "nhs_number", "ethnic", "HES")
    got = {(r["nhs_number"], r["latest_ethnicity"]) for r in out.collect()}
    exp = {(e, v) for e, v in golden.expected("A5_SOURCE").items() if v != golden.ABSENT}
    assert got == exp
    with pytest.raises(ValueError):
        compat.get_latest_ethnicity_no_reallocation(gp, "date_of_journal_item", "nhs_number", "ethnic", "XYZ")
