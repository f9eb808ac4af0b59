"""Every registered query against its DuckDB oracle (sf0.001), the way the
driver compares them: sorted column names, row count, order-free value hash."""

import pytest

import __spark_entry__ as E
from opslens.plans import QUERIES as PLANS
from tools.oracle_check import digest

from .conftest import SF_SMALL

QUERIES = {n: q for n, q in E.queries().items() if n in PLANS}  # the llm folder tests its own
ORACLES = {n: q for n, q in E.oracle_sql().items() if n in PLANS}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck_small, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck_small.execute(ORACLES[name]).df()
    assert digest(got) == digest(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["metric", "ts", "id", "value", "expected_value", "deviation", "severity",
                          "description"]
    assert len(rows) > 0


def test_every_query_has_oracle_or_is_listed():
    no_oracle = set(QUERIES) - set(ORACLES)
    assert no_oracle == set()
