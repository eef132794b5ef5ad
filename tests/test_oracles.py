"""Every query that has SQL gives its rows."""

import pytest

from tessera import queries
from tests.oracle import connection, same

CORE = queries.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    assert same(CORE[name](spark, sf), queries.oracle_sql()[name], connection(sf)) > 0


@pytest.mark.parametrize("name", sorted(set(CORE) - set(queries.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert CORE[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(queries.oracle_sql()) <= set(CORE)
