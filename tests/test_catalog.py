import pytest

from pulsegrid.plans import catalog, services
from tests.parity import differences

SF = "/root/testdata/sf0.01"
ALL = catalog.queries() | services.queries()
SQL = catalog.oracle_sql() | services.oracle_sql()


@pytest.mark.parametrize("name", sorted(ALL))
def test_matches_sql(spark, name):
    assert differences(spark, SF, ALL[name], SQL[name]) == []
