import pytest
from oracle import spark_rows, sql_rows

from tessera.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_its_sql(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == sql_rows(ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_keys_stay_integers(spark, sf, name):
    df = QUERIES[name](spark, sf)
    first = {"op1_html": "page_id", "op9_chat": "conv_id"}.get(name, "doc_id")
    assert dict(df.dtypes)[first] == "bigint" and df.count() > 0
