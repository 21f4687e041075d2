"""Every catalogue query against its DuckDB oracle (sf0.001; the driver uses sf0.01)."""

import re

import pytest

import __spark_entry__ as E
from scales import SF_SMALL
from oracle import compare, duck

# queries of the llm subpackage are tested in tests/llm
APART = re.compile(r"op\d+_|pipeline$")
QUERIES = {k: q for k, q in E.queries().items() if not APART.match(k)}
SQL = {k: q for k, q in E.oracle_sql().items() if not APART.match(k)}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    n, problems = compare(spark, con, SF_SMALL, QUERIES[name], SQL[name])
    assert not problems, problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["entity", "modal", "latest"]
    assert df.count() > 0
