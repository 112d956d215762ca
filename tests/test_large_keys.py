"""The segmented path gives what the plain window gives, with one key holding most rows."""

import math

import pytest
from pyspark.sql import functions as F

from panelforge.operators import candles as C, metrics as M, ordered as O, windows as N


@pytest.fixture(scope="module")
def rows(spark):
    """600 rows: half belong to one key, some times are equal, some values NULL."""
    d = spark.range(600).withColumn("k", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7))
    d = d.withColumn("k", F.when(F.col("k") == 3, None).otherwise(F.col("k")))  # NULL is a key too
    d = d.withColumn("t", (F.col("id") * 37 % 211).cast("bigint"))
    d = d.withColumn("x", (F.col("id") * 7919 % 101).cast("double"))
    return d.withColumn("y", F.when(F.col("id") % 5 != 0, F.col("x"))).cache()


def same(a, b, cols):
    key = lambda r: r["id"]
    left, right = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert len(left) == len(right)
    for l, r in zip(left, right):
        for c in cols:
            if isinstance(l[c], float) and r[c] is not None:
                assert math.isclose(l[c], r[c], rel_tol=1e-9, abs_tol=1e-9), (l["id"], c, l[c], r[c])
            else:
                assert l[c] == r[c], (l["id"], c, l[c], r[c])


K, T = ["k"], ["t", "id"]


def both(rows, spark, make, cols):
    assert O.splitters(rows, K, T) is not None
    same(make(rows, O.AUTO), make(rows, None), cols)


def test_bounded_frames(spark, rows, small_segments):
    def make(d, split):
        steps = [
            N.lags.step(T, "x", [1, 3, -2]), N.rolling.step(T, "y", [4, 40], ["avg", "std", "max", "count"], min_periods=1),
            N.rolling.step(T, "x", [5], ["median"], center=True), N.recent_past.step(T, "x", [10]), N.rolling_slope.step(T, "x"),
        ]
        return O.chain(d, K, T, *steps, split=split)

    cols = make(rows, None).columns
    both(rows, spark, make, [c for c in cols if c not in ("k",)])


def test_running(spark, rows, small_segments):
    aggs = ["count", "sum", "avg", "min", "max", "std_samp", "std_pop"]
    for exclude in (False, True):
        both(rows, spark, lambda d, s: O.running(d, K, T, ["x", "y"], aggs, exclude, split=s), [f"{c}_running_{a}" for c in "xy" for a in aggs])


def test_fill_and_positions(spark, rows, small_segments):
    both(rows, spark, lambda d, s: O.fill(d, K, T, "y", split=s), ["y"])
    both(rows, spark, lambda d, s: O.fill(d, K, T, "y", back=True, split=s), ["y"])
    both(rows, spark, lambda d, s: O.positions(d, K, T, split=s), ["pos"])
    both(rows, spark, lambda d, s: N.since_last(d, K, T, "t", F.col("x") > 80, shift=1, split=s), ["since_last"])


def test_smoothers(spark, rows, small_segments):
    bars = rows.withColumns({"close": F.col("x") + 1, "high": F.col("x") + 3, "low": F.col("x") - 2})
    make = lambda d, s: O.chain(bars, K, T, N.ewm.step(T, "y", 0.3), C.rsi.step(T), C.atr.step(T), C.macd.step(T), C.directional.step(T, 5), split=s)
    same(make(bars, O.splitters(bars, K, T)), make(bars, None), ["y_ewm", "rsi", "cmo", "atr", "macd", "macd_signal", "plus_di", "adx", "adxr"])


def test_quantiles(spark, rows, small_segments):
    got = {r["k"]: r for r in O.group_quantiles(rows, "k", "y", [0.1, 0.5, 0.99]).collect()}
    want = rows.groupBy("k").agg(*[F.percentile("y", q).alias(f"y_q{q}") for q in (0.1, 0.5, 0.99)]).collect()
    for w in want:
        for q in (0.1, 0.5, 0.99):
            assert got[w["k"]][f"y_q{q}"] == pytest.approx(w[f"y_q{q}"])


def test_whole_table_order(spark, rows, small_segments):
    d = rows.withColumns({"label": (F.col("id") % 3 == 0).cast("int"), "p": F.col("x") / 101})
    r = [(x["label"], x["p"]) for x in d.collect()]
    pairs = [(1.0 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0.0) for a in r if a[0] for b in r if not b[0]]
    assert M.auc(d, "label", "p").first()["auc"] == pytest.approx(sum(pairs) / len(pairs))
    got = O.positions_all(d, ["t", "id"]).collect()
    assert [x["id"] for x in sorted(got, key=lambda x: x["pos"])] == [x["id"] for x in sorted(got, key=lambda x: (x["t"], x["id"]))]


def test_splitters_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(O, "MAX_SPLITTERS", 20)
    spark.conf.set("panelforge.segmentRows", "2")
    try:
        d = spark.range(2000).withColumn("k", F.lit(1))
        sp = O.splitters(d, "k", "id")
        assert sum(len(r["_pts"]) for r in sp.table.collect()) <= 20
        assert O.positions(d, "k", "id", split=sp).filter("pos <> id + 1").count() == 0
    finally:
        spark.conf.unset("panelforge.segmentRows")
