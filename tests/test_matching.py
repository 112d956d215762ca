"""Matching operators against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import joins as J, metrics as M
from panelforge.session import stored


def made(spark, n, seed, key=None):
    r = random.Random(seed)
    return [(key if key is not None else r.choice("aab"), i, r.randrange(300), float(r.randrange(20))) for i in range(n)]


@pytest.mark.parametrize("dense", [3, 10**6])
def test_band_topk(spark, dense):
    left, right = made(spark, 60, 1), made(spark, 200, 2)
    l = spark.createDataFrame(left, "k string, lid bigint, lt bigint, z double")
    r = spark.createDataFrame(right, "k string, rid bigint, rt bigint, s double")
    for tol in (1, 7, 40):
        out = J.band_topk_join(l, r, "k", "lid", "lt", "rt", "rid", tol, "s", 3, unique=["s"], dense=dense)
        got = {}
        for x in out.collect():
            got.setdefault((x["k"], x["lid"]), []).append((x["rank"], x["rid"]))
        for k, lid, lt, _ in left:
            near = sorted([(-s, rid) for k2, rid, rt, s in right if k2 == k and abs(rt - lt) <= tol])
            best, seen = [], set()
            for s, rid in near:
                if s not in seen:
                    seen.add(s)
                    best.append(rid)
            assert [rid for _, rid in sorted(got.get((k, lid), []))] == best[:3]


def test_neighbors_are_strict(spark):
    left, right = made(spark, 40, 3), made(spark, 80, 4)
    l = spark.createDataFrame(left, "k string, lid bigint, lt bigint, z double")
    r = spark.createDataFrame(right, "k string, rid bigint, rt bigint, s double")
    for way in ("before", "after"):
        got = {x["lid"]: x[f"rt_{way}"] for x in J.neighbors_join(l, r, "k", "lid", "lt", "rt", "rid", ["rt"], 4, way).collect()}
        for k, lid, lt, _ in left:
            near = [rt for k2, _, rt, _ in right if k2 == k and (rt < lt if way == "before" else rt > lt)]
            assert got[lid] == sorted(near, reverse=way == "before")[:4]


def test_intervals_are_closed(spark):
    p = spark.createDataFrame([("a", i, float(t)) for i, t in enumerate([0, 1, 2, 5, 6, 9, 10])], "k string, i bigint, t double")
    iv = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 3.0), ("a", 9.0, 9.0), ("a", 8.0, 7.0), ("b", 0.0, 99.0)], "k string, start double, end double")
    assert sorted(r["t"] for r in J.in_intervals(p, iv, "k", "t", "i").collect()) == [1.0, 2.0, 5.0, 9.0]


def brute_match(truth, dets, tol):
    free, out = set(range(len(truth))), {}
    for i, t, s in sorted(dets, key=lambda d: (-d[2], d[0])):
        near = sorted((abs(t - truth[g]), truth[g], g) for g in free if abs(t - truth[g]) < tol)
        out[i] = bool(near)
        if near:
            free.discard(near[0][2])
    return out


def test_greedy_match(spark):
    r = random.Random(5)
    truth = [r.uniform(0, 100) for _ in range(60)]
    dets = [(i, r.uniform(0, 100), r.random()) for i in range(150)]
    t = spark.createDataFrame([("v", x, tol) for x in truth for tol in (0.2, 1.0, 5.0)], "k string, time double, tolerance double")
    d = spark.createDataFrame([("v", i, x, s, tol) for i, x, s in dets for tol in (0.2, 1.0, 5.0)], "k string, did bigint, time double, score double, tolerance double")
    got = J.greedy_match(t, d, "k", "time", "score", "did").collect()
    assert len(got) == 450
    for tol in (0.2, 1.0, 5.0):
        assert {x["did"]: x["matched"] for x in got if x["tolerance"] == tol} == brute_match(truth, dets, tol)


@pytest.mark.parametrize("scores, tol", [("random", 0.06), ("random", 0.11), ("falling", 0.11), ("tied", 0.06)])
def test_match_of_a_cut_run(spark, scores, tol):
    """One unbroken chain in pieces of few rows, in rounds: as if it were one piece. Some times are equal, the key is NULL."""
    r = random.Random(7)
    truth = [round(i * 0.04 + r.random() * 0.01, 3) for i in range(700)] + [5.0, 5.0]
    times = [round(i * 0.025 + r.random() * 0.005, 3) for i in range(1100)] + [5.0, 5.0, -3.0]
    score = {"random": lambda i: r.random(), "falling": lambda i: -float(i), "rising": float, "tied": lambda i: float(i % 3)}[scores]
    dets = [(i, x, score(i)) for i, x in enumerate(times)]
    t = spark.createDataFrame([(None, x, tol) for x in truth], "k string, time double, tolerance double")
    d = spark.createDataFrame([(None, i, x, s, tol) for i, x, s in dets], "k string, did bigint, time double, score double, tolerance double")
    got = J.greedy_match(t, d, "k", "time", "score", "did", rows=400).collect()
    assert len(got) == len(dets)
    assert {x["did"]: x["matched"] for x in got} == brute_match(truth, dets, tol)


def test_match_of_a_long_chain(spark):
    """120,000 rows without a gap: pieces of at most a few thousand rows give what one piece of all rows gives."""
    t = spark.range(60_000).select(F.lit("v").alias("k"), (F.col("id") + F.rand(1) / 2).alias("time"), F.lit(1.5).alias("tolerance"))
    d = spark.range(60_000).select(F.lit("v").alias("k"), F.col("id").alias("did"), (F.rand(2) * 60_000).alias("time"), F.rand(3).alias("score"), F.lit(1.5).alias("tolerance"))
    t, d = stored(t), stored(d)
    whole, cut = (J.greedy_match(t, d, "k", "time", "score", "did", rows=n) for n in (10**9, 3_000))
    assert whole.count() == 60_000 and whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty()


def test_match_is_strict_at_the_tolerance(spark):
    t = spark.createDataFrame([("v", 10.0, 1.0)], "k string, time double, tolerance double")
    d = spark.createDataFrame([("v", 1, 11.0, 0.9, 1.0), ("v", 2, 10.5, 0.8, 1.0)], "k string, did bigint, time double, score double, tolerance double")
    assert {r["did"]: r["matched"] for r in J.greedy_match(t, d, "k", "time", "score", "did").collect()} == {1: False, 2: True}


def test_event_ap_by_hand(spark):
    truth = spark.createDataFrame(
        [("v", 0.0, "start"), ("v", 100.0, "end"), ("v", 10.0, "play"), ("v", 50.0, "play"), ("v", 70.0, "throw")], "video_id string, time double, event string")
    dets = spark.createDataFrame(
        [("v", 10.1, "play", 0.9, 1), ("v", 30.0, "play", 0.8, 2), ("v", 50.2, "play", 0.7, 3), ("v", 100.0, "throw", 0.6, 4), ("v", 101.0, "play", 0.99, 5)],
        "video_id string, time double, event string, score double, det_id bigint")
    table = {(r["event"], r["tolerance"]): r["ap"] for r in M.event_ap_table(truth, dets, {"play": [0.15, 0.5], "throw": [0.5]}).collect()}
    assert table[("play", 0.15)] == pytest.approx(0.5)
    assert table[("play", 0.5)] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert table[("throw", 0.5)] == 0.0
    assert M.event_ap(truth, dets, {"play": [0.15, 0.5], "throw": [0.5]}).first()["event_ap"] == pytest.approx((0.5 + 0.5 + 1 / 3) / 2 / 2)
