"""Queries against their SQL."""

import pytest

from sieveline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    want = duck.sql(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    text = lambda df: sorted(map(tuple, df[cols].astype(str).to_numpy().tolist()))
    assert text(got) == text(want)
