"""Every query of the engine against DuckDB on the smallest tables."""

import duckdb
import pytest

from litgrid.plans import registry
from litgrid.sources.tables import TABLES

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows_of(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i].isoformat() if hasattr(r[i], "isoformat") else r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, small, duck, name):
    df = registry.queries()[name](spark, small)
    got = df.collect()
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, got) == rows_of(names, want.fetchall())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(ORACLES)


def test_filters_reach_the_reader(spark, small):
    plan = registry.queries()["search_page"](spark, small)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "o_orderstatus" in pushed and "o_orderdate" in pushed and "o_orderpriority" in pushed
    assert "TakeOrderedAndProject" in plan or "Limit" in plan


@pytest.mark.parametrize("name", ["summary_page_join", "convert_ids", "fulltext_chain", "unresolved_ids"])
def test_no_cartesian_product(spark, small, name):
    plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
