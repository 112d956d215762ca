"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from panelforge.plans import OPERATORS, ORACLE, QUERIES

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(PATH)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES, ORACLE, PATH) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_names_its_operators():
    assert set(OPERATORS) == set(QUERIES) and all(OPERATORS.values())
