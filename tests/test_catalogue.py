import importlib

import pytest

from millrace.plans import catalogue
from tests.helpers import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(catalogue.queries()[name](spark, sf_dir), catalogue.oracle_sql()[name], sf_dir)


def test_entry_has_rows(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
