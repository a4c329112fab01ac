import pytest
from oracle import spark_rows, sql_rows

from tessera.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    names, rows = spark_rows(QUERIES[name](spark, sf))
    if name in ORACLES:
        assert (names, rows) == sql_rows(ORACLES[name], sf)
    else:
        assert names and rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())
