"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare

FOLDER = "/root/testdata/sf0.001"
# rows only; each has its own tests on fixtures
SLOW = {"adaptive_run", "stream_adaptive_run", "model_selection", "ensemble_fit_predict"}


@pytest.fixture(scope="module")
def tables():
    return compare.connect(FOLDER)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_query(spark, tables, name):
    good, text = compare.check(spark, tables, name, FOLDER)
    assert good, text
