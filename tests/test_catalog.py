"""Every registered query of the library's own operators against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as registered
from skirmish.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, sf_dir, same_as_sql, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLES:
        same_as_sql(df, catalog.ORACLES[name])
    else:
        df.collect()


def test_entry_runs(spark):
    assert registered.entry(spark).count() > 0
    assert set(registered.oracle_sql()) <= set(registered.queries())
