"""Every query of the library against its SQL, on whole tables."""

import pytest
from oracle import differences

from pactum.plans import registry

WITHOUT_SQL = sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, sf, name):
    assert differences(spark, sf, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_has_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
