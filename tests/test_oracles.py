"""Every registered catalog query that has SQL against DuckDB on the smallest tables."""

import pytest
from compare import compare, connect
from tables import SF
from vitrine.plans import registry

registry.load()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLE_SQL])
def test_same_rows(spark, db, name):
    assert compare(spark, db, SF, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE_SQL])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
