"""Hypothesis-generated entities against the brute-force model.

Each example is a batch of small entities (so one Spark job checks many
cases); hypothesis searches for records that break an operator and shrinks a
failure to a minimal batch.
"""

import datetime as dt
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import model
from test_model import SCHEMA
from tierwise import PRESETS, ColumnSpec, Rule, latest_rows, modal_by_entity

SPEC = ColumnSpec()
CODES = st.sampled_from(["A", "B", "S", "Z", "99", None])
DAYS = st.sampled_from([dt.date(2020, 1, d) for d in (1, 2, 3)] + [None])
SOURCES = st.sampled_from(["apc", "ae", "op", "oth", None])
FLAGS = st.sampled_from([0, 1, None])
RECORD = st.tuples(CODES, DAYS, SOURCES, FLAGS)
BATCH = st.lists(st.lists(RECORD, min_size=1, max_size=6), min_size=1, max_size=25)


def _frame(spark, batch):
    rows, rid = [], 0
    for i, records in enumerate(batch):
        for c, d, s, f in records:
            rows.append((rid, f"e{i}", c, d, s, f))
            rid += 1
    return spark.createDataFrame(rows, SCHEMA), model.group([dict(zip(SCHEMA.names, r)) for r in rows])


@pytest.mark.parametrize("preset", ["unknown_any_other", "none"])
@pytest.mark.parametrize("rule", ["none", "source", "flag"])
def test_latest_and_modal_against_model(spark, preset, rule):
    pol = PRESETS[preset]

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(BATCH)
    def check(batch):
        df, groups = _frame(spark, batch)
        got = Counter((r["entity"], r["latest"]) for r in latest_rows(df, SPEC, Rule(rule), pol).collect())
        exp = []
        for e, rs in groups.items():
            kept = model.latest_realloc(rs, rule, pol.not_valid, pol.other) if pol.reallocate else model.latest_plain(rs, rule)
            exp += [(e, v) for _, v in kept]
        if rule == "flag":
            assert got == Counter(exp)
        else:
            assert set(got) == set(exp) and all(n == 1 for n in got.values())
        m = {r["entity"]: r["modal"] for r in modal_by_entity(df, SPEC, pol).collect()}
        for e, rs in groups.items():
            assert m[e] == model.modal(model.top_rows(rs, pol.not_valid, pol.other) if pol.reallocate else rs)

    check()
