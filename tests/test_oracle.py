"""Every registered query against its SQL on the smallest given tables."""

import pytest

import __spark_entry__ as entry
from tools.check import compare

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    ok, note = compare(spark, FOLDER, name, entry.queries()[name], ORACLES.get(name))
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
