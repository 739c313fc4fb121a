"""Every query without the optional subpackage, against its SQL on the same rows."""

from __future__ import annotations

import pytest

from strandline.plans import catalog
from tests.conftest import duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_equal_those_of_the_sql(spark, sf_dir, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    columns, expected = duck_rows(catalog.ORACLES[name], sf_dir)
    assert sorted(found.columns) == columns
    assert rows_of(found.columns, found.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_without_sql_run(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).columns


def test_every_query_with_sql_is_registered():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
