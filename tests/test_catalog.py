"""Every query with SQL equals DuckDB; the others give rows with a stable schema."""

import pytest
from conftest import DATA, rows_of

from tallygrove import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    if name in catalog.ORACLES:
        assert rows_of(df) == rows_of(duck.execute(catalog.ORACLES[name]).df())
    else:
        assert df.columns and (df.count() > 0 or name == "hexagon_counts")  # cells of one place are withheld


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
