"""Every query of the store against its SQL."""

import pytest

from millrace import registry
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, duck):
    same_rows(registry.QUERIES[name](spark, sf), duck, registry.ORACLES[name])


def test_all_have_oracles():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
