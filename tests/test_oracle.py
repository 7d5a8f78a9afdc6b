"""Every core query against its SQL on the smallest tables."""

import pytest

from compare import connect, same
from dossier import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    same(spark, con, queries.queries()[name], queries.oracle_sql()[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, FOLDER).count() > 0
