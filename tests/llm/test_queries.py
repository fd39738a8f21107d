"""The registered queries on the smallest tables: against SQL where there is some, else that they run."""

import pytest

from conftest import DATA
from oracle import rows_of, rows_of_sql
from sightline.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, DATA)
    got = rows_of(df)
    sql = Q.oracle_sql().get(name)
    if sql:
        assert got == rows_of_sql(duck, sql, df.columns)
