"""Every registered query agrees with its SQL on the smallest tables; without SQL it gives rows."""

import pytest

import __spark_entry__ as entry
from conftest import SF, same_rows
from strandline import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF).toPandas()
    if name in registry.oracles():
        same_rows(found, duck(registry.oracles()[name]))
    else:
        assert len(found) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
