import pytest
from oracle import connect, rows

import docketry.plans.corpus_queries  # noqa: F401
import docketry.plans.more_queries  # noqa: F401
import docketry.plans.rule_queries  # noqa: F401
from docketry.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"authorship_classifier"}))
def test_runs_and_repeats(spark, sf, name):
    first, again = QUERIES[name](spark, sf).toPandas(), QUERIES[name](spark, sf).toPandas()
    assert len(first) and rows(first) == rows(again)
