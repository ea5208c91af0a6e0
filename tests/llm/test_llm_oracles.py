"""Queries of the corpus operators that SQL can express."""

import oracle
import pytest

from siftwell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    assert oracle.rows_of_spark(queries.QUERIES[name](spark, oracle.FOLDER)) == oracle.rows_of_sql(oracle.connection(), queries.ORACLES[name])
