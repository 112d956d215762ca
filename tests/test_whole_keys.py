"""Results that must not depend on the size of a key: no cut histories, pieces or types."""

import datetime as dt
import heapq
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import candles as C, ordered as O, sequences as Q, splitting as V, windows as N
from panelforge.operators.splitting import _deal
from panelforge.sources import files as IO


def frame(spark, values, keys=1):
    rows = [(k, i, None if v is None else float(v)) for k in range(keys) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k int, t int, x double")


@pytest.mark.parametrize("segments", [False, True])
def test_ewm_after_long_gaps(spark, segments, request):
    if segments:
        request.getfixturevalue("small_segments")
    values = [None, 1.5, 2.0] + [None] * 1500 + [4.0, 3.0] + [None] * 130
    got = [r["e"] for r in N.ewm(frame(spark, values), "k", "t", "x", 0.6, name="e").orderBy("t").collect()]
    want = pd.Series(values, dtype=float).ewm(alpha=0.6).mean()
    np.testing.assert_allclose([np.nan if g is None else g for g in got], want, rtol=1e-12)
    shifted = [r["e"] for r in N.ewm(frame(spark, values), "k", "t", "x", 0.6, shift=2, name="e").orderBy("t").collect()]
    np.testing.assert_allclose([np.nan if g is None else g for g in shifted], pd.Series(values, dtype=float).shift(2).ewm(alpha=0.6).mean(), rtol=1e-12)


def test_small_recent_values_keep_old_ones(spark):
    values = [1e6] + [0.0] * 200
    got = [r["e"] for r in N.ewm(frame(spark, values), "k", "t", "x", 0.6, name="e").orderBy("t").collect()]
    np.testing.assert_allclose(got, pd.Series(values).ewm(alpha=0.6).mean(), rtol=1e-9)


def wilder(values, n):
    """Relative strength by the plain recurrence; a NULL move decays the state."""
    u = v = None
    seen, ups, downs, out, prev = 0, [], [], [], None
    for x in values:
        d = None if x is None or prev is None else x - prev
        prev = x
        if d is not None:
            seen += 1
            if seen <= n:
                ups.append(max(d, 0)), downs.append(max(-d, 0))
        if u is None:
            if seen == n:
                u, v = sum(ups) / n, sum(downs) / n
        else:
            u, v = u * (n - 1) / n + (0 if d is None else max(d, 0)) / n, v * (n - 1) / n + (0 if d is None else max(-d, 0)) / n
        out.append(None if u is None else 0.0 if u + v == 0 else 100 * u / (u + v))
    return out


@pytest.mark.parametrize("segments", [False, True])
def test_rsi_counts_over_the_whole_past(spark, segments, request):
    if segments:
        request.getfixturevalue("small_segments")
    r = random.Random(1)
    values = [100 + r.random() for _ in range(60)] + [None] * 900 + [100 + r.random() for _ in range(240)]
    got = C.rsi(frame(spark, values).withColumnRenamed("x", "close"), "k", "t").orderBy("t").collect()
    for g, w in zip(got, wilder(values, 14)):
        assert (g["rsi"] is None) == (w is None) and (w is None or g["rsi"] == pytest.approx(w, rel=1e-9))


def test_running_types_do_not_follow_the_size(spark, small_segments):
    day = dt.date(2020, 1, 1)
    rows = [("a", i, day + dt.timedelta(days=i * 37 % 101), i % 7) for i in range(300)] + [("b", i, day, i) for i in range(3)]
    d = spark.createDataFrame(rows, "k string, t int, d date, n int").withColumn("m", (F.col("n") / 8).cast("decimal(10,2)"))
    held = O.running(d, "k", "t", ["d"], ["min", "max", "count"])
    best = {}
    for r in held.orderBy("k", "t").collect():
        lo, hi = best.get(r["k"], (r["d"], r["d"]))
        best[r["k"]] = lo, hi = min(lo, r["d"]), max(hi, r["d"])
        assert (r["d_running_min"], r["d_running_max"]) == (lo, hi)
    big, small = O.running(d, "k", "t", ["m"], ["avg", "sum"]), O.running(d, "k", "t", ["m"], ["avg", "sum"], split=None)
    assert big.schema == small.schema
    assert sorted(map(tuple, big.collect())) == sorted(map(tuple, small.collect()))


def test_pieces_are_not_keys(spark):
    d = spark.createDataFrame([(k, i, i) for k, n in ((1, 50), (2, 6)) for i in range(n)], "k int, t int, v int")
    assert {r["k"] for r in Q.longer_keys(d, "k", 6).collect()} == {1}
    pieces = Q.sequences(Q.longer_keys(d, "k", 6), "k", "t", "v", 45)
    assert sorted((r["piece"], len(r["v"])) for r in pieces.collect()) == [(0, 45), (1, 5)]
    assert {r["k"]: r["v"] for r in Q.first_n(d, "k", "t", "v", 3).collect()} == {1: [0, 1, 2], 2: [0, 1, 2]}
    assert {r["k"]: r["v"] for r in Q.last_n(d, "k", "t", "v", 2).collect()} == {1: [48, 49], 2: [4, 5]}
    with pytest.raises(TypeError):
        Q.sequences(d, "k", "t", "v")


def one_by_one(classes, k):
    loads, out = [(0, i) for i in range(k)], []
    for size, count in classes:
        for _ in range(count):
            load, i = heapq.heappop(loads)
            heapq.heappush(loads, (load + size, i))
            out.append(i)
    return out


def test_deal_in_phases():
    r = random.Random(3)
    for _ in range(300):
        k = r.randrange(1, 6)
        classes = sorted({r.randrange(1, 60): r.randrange(1, 30) for _ in range(r.randrange(1, 6))}.items(), reverse=True)
        got = []
        for (size, phases), (_, count) in zip(_deal(classes, k), classes):
            assert len(phases) <= 2 * k
            for (at, turn), (end, _) in zip(phases, [*phases[1:], (count, None)]):
                got += [turn[j % len(turn)] for j in range(end - at)]
        assert got == one_by_one(classes, k)
    [(_, first), (_, rest)] = _deal([(10_000_000, 1), (1, 40_000_000)], 4)
    assert len(first) == 1 and rest[0] == (0, [1, 2, 3]) and len(rest) == 2


def test_multilabel_balance(spark):
    r = random.Random(4)
    rows = [(i, r.choice("aaab"), r.choice("xxxxxxxy"), r.choice([0, 1])) for i in range(900)]
    d = spark.createDataFrame(rows, "id int, a string, b string, c int")
    got = V.multilabel_fold(d, ["a", "b", "c"], "id", 5)
    assert got.columns == [*d.columns, "fold"] and got.count() == 900
    y = [r["n"] for r in got.filter("b = 'y'").groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(y) == 5 and max(y) - min(y) <= 1  # the rarest value of all


def test_assembled_blocks_keep_every_key(spark):
    a = spark.createDataFrame([(1, 10), (None, 11)], "k int, x int")
    b = spark.createDataFrame([(2, 20), (None, 21)], "k int, y int")
    c = spark.createDataFrame([(2, 30), (3, 31)], "k int, z int")
    got = IO.assemble({"p": a, "q": b, "r": c}, "k")
    assert got.columns == ["k", "x", "y", "z"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 10, None, None), (None, 11, 21, None), (2, None, 20, 30), (3, None, None, 31)], key=repr)


def test_runs_cut_by_batches():
    from panelforge.operators.joins import _match_runs

    r = random.Random(5)
    rows, run = [], 0
    for key in (1.0, 1.0, None, 2.0):
        run += 1
        for i in range(r.choice([1, 5, 40])):
            rows.append((key, run, 10.0, float(i), i % 2, i, r.random() if i % 2 else np.nan))
    whole = pd.DataFrame(rows, columns=["k", "_run", "tolerance", "_t", "_isd", "_id", "_score"])

    def matched(size):
        parts = [whole.iloc[i : i + size] for i in range(0, len(whole), size)]
        return pd.concat(list(_match_runs(["k"], "tolerance", iter(parts)))).reset_index(drop=True)

    want = matched(len(whole))
    for size in (1, 2, 3, 7, 39):
        pd.testing.assert_frame_equal(matched(size), want)


def test_group_values_beside_rows_take_two_exchanges(spark):
    d = spark.createDataFrame([(1, None, 1.0), (1, None, 3.0), (None, "x", 5.0), (2, "x", 7.0)], "a int, b string, v double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = N.transform_agg(d, ["a", "b"], {"m": F.avg("v")})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
        assert sorted((r["v"], r["m"]) for r in out.collect()) == [(1.0, 2.0), (3.0, 2.0), (5.0, 5.0), (7.0, 7.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
