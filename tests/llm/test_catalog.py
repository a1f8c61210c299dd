"""The queries of the package against DuckDB where SQL can express them, on the smallest tables."""

import os

import pytest

from docsieve.llm import catalog
from tests.test_catalog import FOLDER, rows_of, tables  # noqa: F401


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, tables, name):  # noqa: F811
    found = catalog.queries()[name](spark, FOLDER)
    rows = found.collect()
    assert len(set(map(str, rows))) == len(rows)
    if name in catalog.oracle_sql():
        wanted = tables.execute(catalog.oracle_sql()[name])
        assert rows_of(found.columns, rows) == rows_of([d[0] for d in wanted.description], wanted.fetchall())
