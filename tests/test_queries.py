import pytest

import __spark_entry__ as entry
from siltstone.plans import catalogue
from tests.compare import duck, same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in catalogue.ORACLES:
        assert not same(df.columns, rows, *duck(catalogue.ORACLES[name], SF))
    assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
