"""Every query of the library against its SQL, on the smallest tables."""

import oracle
import pytest

from cuewright import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert oracle.differences(spark, catalog.queries()[name], catalog.oracle_sql()[name]) == []


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.FLAGSHIP in entry.queries()
