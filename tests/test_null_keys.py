"""Joins on time treat NULL as a key like any other."""

import pytest

from panelforge.operators import joins as J

LEFT = [(k, i, t) for i, (k, t) in enumerate([("a", 5), (None, 5), (None, 20), ("a", 20), ("b", 7)])]
RIGHT = [(k, i, t, float(t % 7)) for i, (k, t) in enumerate([("a", 1), (None, 2), (None, 4), (None, 6), ("a", 9), (None, 18), ("a", 19), (None, 30)])]


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(LEFT, "k string, l int, lt bigint"), spark.createDataFrame(RIGHT, "k string, r int, rt bigint, v double")


@pytest.mark.parametrize("direction", ["before", "after"])
def test_neighbors(spark, sides, direction):
    got = {r["l"]: r[f"rt_{direction}"] for r in J.neighbors_join(*sides, "k", "l", "lt", "rt", "r", ["rt"], 2, direction).collect()}
    for k, i, t in LEFT:
        near = [x for q, _, x, _ in RIGHT if q == k and (x < t if direction == "before" else x > t)]
        assert got[i] == sorted(near, reverse=direction == "before")[:2]


@pytest.mark.parametrize("dense", [50_000, 1])
def test_band(spark, sides, dense):
    got = {(r["l"], r["r"]) for r in J.band_topk_join(*sides, "k", "l", "lt", "rt", "r", 3, "v", 5, dense=dense).collect()}
    assert got == {(i, j) for k, i, t in LEFT for q, j, x, _ in RIGHT if q == k and abs(x - t) <= 3}


def test_between(spark, sides):
    got = {(r["l"], r["r"]) for r in J.between_neighbors_join(*sides, "k", "l", "lt", "rt", "r", ["v"]).collect()}
    want = set()
    for k, i, t in LEFT:
        times = [x for q, _, x in LEFT if q == k]
        low, high = max([x for x in times if x < t], default=-1), min([x for x in times if x > t], default=99)
        want |= {(i, j) for q, j, x, _ in RIGHT if q == k and low < x < high}
    assert got == want
