"""Every query of the subpackage gives the rows of its SQL; those without SQL give a row per input row."""

import pytest
from compare import compare, connect
from conftest import SF

from lakekit.llm import queries

INPUT = {"op9_projection_forest": "embeddings"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.SQL:
        assert compare(df, duck, queries.SQL[name]) is None
    else:
        assert df.count() == spark.read.parquet(f"{SF}/{INPUT.get(name, 'documents')}.parquet").count()
