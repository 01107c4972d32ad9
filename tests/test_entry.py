"""The driver's contract."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from quarry import catalog


def test_every_sql_has_a_query():
    assert entry_module.oracle_sql().keys() <= entry_module.queries().keys()
    assert catalog.queries().keys() <= entry_module.queries().keys()


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
def test_flagship(spark):
    found = entry_module.entry(spark)
    rows = found.collect()
    assert 0 < len(rows) <= 10 and [r.o_totalprice for r in rows] == sorted((r.o_totalprice for r in rows), reverse=True)
