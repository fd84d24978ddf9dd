"""Every operator over stated cases."""

import duckdb
import pytest

from . import cases
from .test_queries import rows_of


@pytest.mark.parametrize("name", sorted(cases.QUERIES))
def test_rows(spark, small, name):
    df = cases.QUERIES[name](spark, small)
    want = duckdb.connect().execute(cases.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want.fetchall())
