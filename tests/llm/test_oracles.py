"""Queries of training-data operators against their SQL."""

from __future__ import annotations

import pytest

from prismata.llm import queries

from ..compare import connect, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, small_dir, name):
    got = queries.QUERIES[name](spark, small_dir).toPandas()
    want = connect(small_dir).execute(queries.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
