import pytest
from compare import connection, same

from clauseloom.plans import ORACLE, QUERIES, answers, clauses, coding, documents, keywords, readings, retrieval, tables, values  # noqa: F401


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, data, con, name):
    same(QUERIES[name](spark, data), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0
