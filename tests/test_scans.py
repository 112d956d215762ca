"""Recurrences along keys: equal to a plain loop, however keys are cut."""

import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import candles as C, ordered as O, scans, windows as N


@pytest.fixture(scope="module")
def bars(spark):
    r = random.Random(7)
    rows = []
    for key, n in (("hot", 300), ("b", 40), (None, 25), ("one", 1), ("two", 2)):
        price = 100.0
        for t in range(n):
            price = max(1.0, price + r.uniform(-3, 3.1))
            high, low = price + r.random() * 3, price - r.random()
            rows.append((key, t, price if r.random() > 0.05 else None, high, low, float(r.randrange(0, 9))))
    return spark.createDataFrame(rows, "k string, t int, close double, high double, low double, volume double").repartition(5)


def by_key(df):
    held = {}
    for r in sorted(df.collect(), key=lambda r: r["t"]):
        held.setdefault(r["k"], []).append(r)
    return held


def both(df, make):
    return make(df, None), make(df, O.splitters(df, "k", "t"))


def test_affine(spark, bars, small_segments):
    d = bars.withColumn("a", F.when(F.col("t") % 50 == 3, 0.0).when(F.col("t") % 7 == 0, None).otherwise(0.9)).withColumn("b", F.col("high"))
    for got in both(d, lambda x, s: scans.affine(x, "k", "t", F.col("a"), F.col("b"), "y", s)):
        for rows in by_key(got).values():
            y = None
            for r in rows:
                if r["a"] is not None:
                    y = r["b"] if r["a"] == 0 else None if y is None else r["a"] * y + r["b"]
                assert (r["y"] is None) == (y is None) and (y is None or r["y"] == pytest.approx(y, rel=1e-9))


def test_machine(spark, bars, small_segments):
    def step(state, values):
        high, low = values
        top = high if state is None or high > state[0] or state[1] > 6 else state[0]
        age = 0 if state is None or top == high else state[1] + 1
        return (top, age), (top, age)

    for got in both(bars, lambda x, s: scans.machine(x, "k", "t", ["high", "low"], step, "top double, age bigint", "m_top double, m_age bigint", s)):
        for rows in by_key(got).values():
            state = None
            for r in rows:
                state, out = step(state, (r["high"], r["low"]))
                assert (r["m_top"], r["m_age"]) == out


def test_indicators_do_not_depend_on_the_cut(spark, bars, small_segments):
    makes = [
        lambda x, s: C.stop_and_reverse(x, "k", "t", split=s), lambda x, s: C.adaptive_mean(x, "k", "t", "high", split=s),
        lambda x, s: C.negative_volume(x.fillna(1.0, ["close"]), "k", "t", split=s), lambda x, s: C.money_flow(x.fillna(1.0, ["close"]), "k", "t", split=s),
        lambda x, s: N.rolling_scale(x.withColumn("v", F.when(F.col("volume") < 3, 0.0).otherwise(F.col("close"))), "k", "t", "v", 20, 5, split=s),
    ]
    for make in makes:
        plain, cut = both(bars, make)
        want = {(r["k"], r["t"]): r for r in plain.collect()}
        got = cut.collect()
        assert len(got) == len(want) == 368
        for r in got:
            for c in plain.columns[2:]:
                x, y = r[c], want[r["k"], r["t"]][c]
                assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-7, abs=1e-9)), c
    first = {r["t"]: r for r in C.stop_and_reverse(bars.filter("k = 'b'"), "k", "t").collect()}
    assert first[0]["psar_up"] is None and first[1]["psar_up"] is None and all((r["psar_up"] is None) != (r["psar_down"] is None) for r in first.values() if r["t"] > 2 and r["close"] is not None)
