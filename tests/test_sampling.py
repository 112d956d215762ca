"""Samples of n rows against a plain sort."""

import pytest
from pyspark.sql import functions as F

from panelforge.operators import ranking as K
from panelforge.session import stored


@pytest.mark.parametrize("n", [0, 1, 7, 400, 5_000])
@pytest.mark.parametrize("kind", ["hash", "whole", "tied", "null", "spread"])
def test_sample_is_the_head_of_the_sort(rows, kind, n):
    draw = {"hash": None, "whole": F.col("whole"), "tied": F.col("id") * 0, "null": F.when(F.col("id") % 3 > 0, F.col("u")), "spread": F.exp(F.col("u") * 60)}[kind]
    order = F.xxhash64("id", F.lit(0)) if draw is None else draw
    want = [r["id"] for r in rows.orderBy(order, "id").limit(n).collect()]
    got = K.sample(rows, "id", n, draw=draw)
    assert got.columns == rows.columns
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


@pytest.fixture(scope="module")
def rows(spark):
    return stored(spark.range(3_000).select("id", F.rand(4).alias("u"), ((F.col("id") * 7919) % 1009).alias("whole")))


def test_sample_of_no_rows_and_of_nulls(spark):
    empty = spark.createDataFrame([], "id bigint, u double")
    nulls = spark.createDataFrame([(None, None), (1, None), (1, None)], "id bigint, u double")
    for draw in (None, F.col("u")):
        assert K.sample(empty, "id", 5, draw=draw).count() == 0
        assert K.sample(nulls, "id", 2, draw=draw).count() == 2
