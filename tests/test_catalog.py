import re

import pytest
from compare import duck_rows, spark_rows
from conftest import SMALL

import __spark_entry__ as entry
from tessella import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    assert spark_rows(catalog.queries()[name](spark, SMALL)) == duck_rows(SMALL, catalog.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_irr_solves(spark):
    """At the rate returned, the later orders are worth the first one; where none is returned, there is no later order or no rate."""
    flows = {}
    for r in spark.read.parquet(f"{SMALL}/orders.parquet").orderBy("o_orderdate", "o_orderkey").collect():
        flows.setdefault(r["o_custkey"], []).append(r["o_totalprice"])
    rates = {r["o_custkey"]: r["irr"] for r in catalog.queries()["irr_by_customer"](spark, SMALL).collect()}
    assert rates.keys() == flows.keys()
    worth = lambda f, rate: -f[0] + sum(x / (1 + rate) ** (k + 1) for k, x in enumerate(f[1:]))
    found = [c for c in rates if rates[c] is not None]
    assert len(found) > len(rates) / 2
    for c in found:
        assert worth(flows[c], rates[c] - 2e-6) >= 0 >= worth(flows[c], rates[c] + 2e-6)


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.queries()["filter_rows"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)ReadSchema", plan).group(1)
    assert "p_size" in pushed and "p_retailprice" in pushed and "p_brand" not in plan
