import pytest
from conftest import SF, same

from phasorlake.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df())


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() == 500
