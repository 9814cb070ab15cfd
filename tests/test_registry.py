import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["HC_subCST", "taxon", "value"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    status, _, _, detail = check(spark, con, name, queries()[name], oracle_sql()[name], SF)
    assert status in ("equal", "close"), detail
