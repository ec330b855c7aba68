"""Every interval query against its SQL at sf0.001, and the rest for their rows."""

import pytest

from spanstat.plans.queries import ORACLES, QUERIES
from tests.compare import oracle, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = spark_rows(QUERIES[name](spark, SF))
    if name in ORACLES:
        assert got == oracle(ORACLES[name], SF)
    else:
        assert got[1]
