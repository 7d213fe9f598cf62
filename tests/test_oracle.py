"""Every registered query against its DuckDB oracle SQL at sf0.001."""
import pytest

import __spark_entry__ as E
from tests.oracle_check import compare_one, duck


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, sf_small, name):
    r = compare_one(spark, con, sf_small, name, E.queries()[name], E.oracle_sql().get(name))
    assert r["match"] is not False, r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["staff_id", "staff_name", "room_code", "is_admin", "team_kpi", "ind_kpi", "total_kpi"]
