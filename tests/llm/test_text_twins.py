"""Queries of the subpackage against their SQL twins, and the pipeline's shape."""

import pytest

from compare import compare, duck
from panelforge.llm import ORACLE, QUERIES

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(PATH)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES, ORACLE, PATH) is None


def test_one_query_per_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
