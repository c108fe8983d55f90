"""Every registered query of the image engine against its SQL, or at least run, at the smallest scale."""

import pytest

from nebulark.plans import registry
from tests.conftest import SMALL
from tests.oracle import check, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SMALL)
    if name in registry.ORACLE:
        check(df, con, registry.ORACLE[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
