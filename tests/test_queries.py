import __spark_entry__
import pytest
from comparing import compare, connected

from matchgrain.plans import registry

SF = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, name):
    compare(spark, connected(SF), registry.queries()[name], ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_point(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
