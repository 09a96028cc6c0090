import pytest
from oracle import compare, connect

from fairway.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    if name in registry.ORACLE_SQL:
        assert compare(spark, db, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) == ""
    else:
        assert registry.QUERIES[name](spark, SF).count() >= 0
