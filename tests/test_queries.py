"""Every query with SQL against DuckDB, and the others for rows and schema."""

import pytest

from wardline.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf, duck, same):
    same(QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df())


def test_every_query_has_sql_and_rows(duck):
    assert set(SQL) == set(QUERIES)
    empty = [k for k in SQL if not duck.execute(f"SELECT count(*) FROM ({SQL[k]})").fetchone()[0]]
    assert empty == []


def test_scans_are_narrow(spark, sf):
    plan = QUERIES["exact_count_by_level"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_the_kernel_runs_once(spark, sf):
    plan = QUERIES["redact_fuzzy"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
