"""Every corpus query with SQL gives the rows of its SQL."""

import pytest
from sql_comparison import FOLDER, of_duckdb, of_spark

from plumbrook.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_are_those_of_the_sql(spark, name):
    assert of_spark(queries.QUERIES[name](spark, FOLDER)) == of_duckdb(queries.SQL[name])
