"""Plan shape of every registered query: no nested-loop or cartesian joins,
no Python UDFs, paged/top-k queries use TakeOrderedAndProject, date-range
reports prune partitions and push filters into the scan."""
import pytest

import __spark_entry__ as E
from checkwise import oracle, queries

FORBIDDEN = ["BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas"]


@pytest.fixture(scope="module")
def plans(spark, sf_small):
    out = {}
    for name, q in E.queries().items():
        df = q(spark, sf_small)
        out[name] = df._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_forbidden_operators(plans):
    bad = {n: [f for f in FORBIDDEN if f in p] for n, p in plans.items()}
    assert {n: f for n, f in bad.items() if f} == {}


def test_topk_and_paging(plans):
    for name in ["kpi_summary_page", "top_violations", "top_violations_room"]:
        assert "TakeOrderedAndProject" in plans[name], name


def test_pruning_and_pushdown(spark, sf_small):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        df = E.queries()["kpi_monthly_room"](spark, sf_small)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(entry_month" in plan
    assert "EqualTo(room_code,MIDDLE EAST)" in plan


def test_registry_matches_oracle_keys():
    assert set(E.queries()) >= set(E.oracle_sql())
    assert set(oracle.oracle_sql()) == set(queries.queries())  # the library's own queries all have SQL
