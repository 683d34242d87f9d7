"""Every query of the library proper against its SQL; those without one against brute force."""

import pytest
from compare import differences

from lumenframe.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    assert differences(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    a, b = __spark_entry__.entry(spark), __spark_entry__.entry(spark)
    assert a.schema == b.schema and a.count() > 0
