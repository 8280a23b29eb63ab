import oracle
import pytest

from marginalia.llm.queries import registry


@pytest.mark.parametrize("name", list(registry.queries))
def test_query_equals_its_sql(spark, small, duck, name):
    what, count, _ = oracle.compare(spark, duck, name, small)
    assert what in ("ok", "no sql") and count > 0


def test_all_registered():
    import __spark_entry__ as e

    assert set(registry.queries) <= set(e.queries()) and set(registry.sql) <= set(e.oracle_sql())
