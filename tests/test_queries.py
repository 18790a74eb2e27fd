"""Every named query against its SQL on the smallest tables, and the driver contract."""

import pytest
from compare import compare

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, contract.queries()[name], SQL[name], SF) == ""


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["LineDesc", "mttr_minutos", "mtbf_minutos", "num_falhas"]
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(contract.queries())
