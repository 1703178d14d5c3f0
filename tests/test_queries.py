"""Every registered query of similarity search and content identity equals its DuckDB oracle."""

import pytest
from oracle import oracle, query

from kinfold.plans.oracles import ORACLES
from kinfold.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = query(spark, QUERIES[name])
    if name in ORACLES:
        assert got == oracle(ORACLES[name])
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 250
    assert set(entry.oracle_sql()) <= set(entry.queries())
