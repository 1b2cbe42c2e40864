"""Every query of the subpackage for rows, and against its SQL where it has one."""

import pytest

pytest.importorskip("wardline.llm")
from wardline.llm import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf, duck, same):
    same(QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df())


def test_native_plans_have_no_python(spark, sf):
    for name in ("op2_multiset_fingerprint", "op4_shard_label_propagation", "op7_mix_sainte_lague"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), name
