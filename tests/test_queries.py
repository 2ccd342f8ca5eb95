"""Every query of the registry against its SQL; those without SQL must at least give rows."""

import pytest

from loomscore.plans import registry
from tests import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, oracle.DATA)
    if name in registry.ORACLE_SQL:
        oracle.check(df, registry.ORACLE_SQL[name], con)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
