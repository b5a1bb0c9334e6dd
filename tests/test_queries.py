"""Every registered query of the engine on the smallest tables: against its oracle, or for rows alone."""

import pytest

from odweave.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()
SLOW = {"hssm_build_genetic"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    if name in SLOW:
        pytest.skip("covered by a small case in test_settlement")
    df = registry.queries()[name](spark, SF)
    if name in ORACLE:
        compare(df, con, ORACLE[name])
    else:
        assert df.columns and df.count() >= 0
