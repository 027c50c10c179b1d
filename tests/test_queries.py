from __future__ import annotations

import pytest

from barweave.plans import catalog
from tests.oracle import DATA, same

@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    n = same(spark, catalog.QUERIES[name], catalog.ORACLE[name])
    assert n > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_has_rows(spark, name):
    if name == "evolve_smoke":
        pytest.skip("see test_search")
    df = catalog.QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
