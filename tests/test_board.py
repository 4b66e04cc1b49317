import pytest

from pulsegrid.plans import board, signals, studies
from tests.parity import differences

SF = "/root/testdata/sf0.01"
MODULES = (board, studies, signals)


@pytest.mark.parametrize(("module", "name"), [(m, n) for m in MODULES for n in sorted(m.oracle_sql())])
def test_matches_sql(spark, module, name):
    assert differences(spark, SF, module.queries()[name], module.oracle_sql()[name]) == []
