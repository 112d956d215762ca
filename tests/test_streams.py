"""Streams over several micro-batches give what their batch twins give."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from panelforge.operators import ordered as O, windows as N
from panelforge.sources.files import scratch
from panelforge.streaming import state as ST

SCHEMA = "k string, i bigint, t bigint, x double"


def rows(spark, n=120):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("k"), F.col("id").alias("i"), (F.col("id") * 10 + F.col("id") % 4).alias("t"),
        (F.col("id") * 31 % 17).cast("double").alias("x")).coalesce(1)


def feed(spark, parts, make):
    """Add the parts one at a time and run the stream after each, with one checkpoint."""
    src, out, ck = (scratch(spark, n) for n in ("src", "out", "ck"))
    for p in parts:
        p.write.mode("append").parquet(src)
        done = ST.run_to_files(make(spark.readStream.schema(p.schema).parquet(src)), out, ck)
    return {r["i"]: r for r in done.collect()}


def close(a, b):
    a = None if a is None or (isinstance(a, float) and math.isnan(a)) else a
    return a == b if a is None or b is None else a == pytest.approx(b)


def test_history_over_batches(spark):
    d = rows(spark)
    got = feed(spark, [d.filter("i < 40"), d.filter("i >= 40 AND i < 90"), d.filter("i >= 90")], lambda s: ST.user_history(s, "k", ["t", "i"], "x", "t", [5], 2))
    b = O.running(d, "k", ["t", "i"], "x", ["count", "avg", "std_pop"], exclude_current=True)
    b = O.chain(b, "k", ["t", "i"], N.recent_past.step(["t", "i"], "x", [5]), N.past_gaps.step(["t", "i"], "t", 2))
    want = b.collect()
    assert len(got) == len(want) == 120
    for w in want:
        g = got[w["i"]]
        for a, c in (("past_count", "x_running_count"), ("past_avg", "x_running_avg"), ("past_std", "x_running_std_pop"), ("past_avg_5", "x_avg_last_5"), ("gap_0", "t_gap_0"), ("gap_1", "t_gap_1")):
            assert close(g[a], w[c]), (w["i"], a, g[a], w[c])


def test_history_from_saved_state(spark):
    d = rows(spark)
    state = ST.history_state(d.filter("i < 60"), "k", ["t", "i"], "x", "t", [5], 2)
    got = feed(spark, [d.filter("i >= 60")], lambda s: ST.user_history(s, "k", ["t", "i"], "x", "t", [5], 2, initial=state))
    whole = feed(spark, [d], lambda s: ST.user_history(s, "k", ["t", "i"], "x", "t", [5], 2))
    for i, g in got.items():
        assert all(close(g[c], whole[i][c] if not (isinstance(whole[i][c], float) and math.isnan(whole[i][c])) else None) for c in ("past_count", "past_avg", "past_std", "past_avg_5", "gap_0", "gap_1"))


def test_late_answers(spark):
    """Answers of a batch arrive with the next one; features hold only what had arrived."""
    s = "k string, i bigint, t bigint, x double, late boolean"
    first = spark.createDataFrame([("a", 1, 1, None, False), ("a", 2, 2, None, False)], s)
    second = spark.createDataFrame([("a", -1, 3, 1.0, True), ("a", -2, 4, 0.0, True), ("a", 3, 5, None, False)], s)
    got = feed(spark, [first, second], lambda q: ST.user_history(q, "k", ["t", "i"], "x", "t", [1], 1, answer="late"))
    assert set(got) == {1, 2, 3}
    assert [got[i]["past_count"] for i in (1, 2, 3)] == [0, 0, 2] and got[3]["past_avg"] == 0.5 and got[3]["past_avg_1"] == 0.0
    assert got[3]["gap_0"] == 1.0


def test_buffers(spark):
    d = rows(spark)
    got = feed(spark, [d.filter("i < 50"), d.filter("i >= 50")], lambda s: ST.last_n_state(s, "k", ["t", "i"], "x", 3))
    held = {}
    for r in d.orderBy("t").collect():
        held.setdefault(r["k"], []).insert(0, r["x"])
        assert got[r["i"]]["recent"] == held[r["k"]][:3]


def test_stages(spark):
    d = spark.createDataFrame([("a", 0, "p", 1.0), ("a", 1, "q", 2.0), ("a", 2, "q", 3.0), ("a", 3, "r", 4.0)], "k string, i bigint, stage string, x double")
    src, out, ck = (scratch(spark, n) for n in ("src", "out", "ck"))
    for part in ("i < 2", "i >= 2"):
        d.filter(part).write.mode("append").parquet(src)
        done = ST.run_to_files(ST.stage_state(spark.readStream.schema(d.schema).parquet(src), "k", "stage", ["p", "q", "r"], "x"), out, ck)
    lines = {(r["stage"], r["q_n"]): (r["p_n"], r["p_sum"], r["q_sum"], r["r_n"]) for r in done.collect()}
    assert lines[("q", 1)] == (1, 1.0, 2.0, None) and lines[("q", 2)] == (1, 1.0, 5.0, None) and lines[("r", 2)] == (1, 1.0, 5.0, 1)


def test_scores_are_checked(spark):
    d = rows(spark, 10)
    src, out = scratch(spark, "src"), scratch(spark, "out")
    d.write.parquet(src)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    ST.score_batches(stream(), lambda b: b.select("i", F.lit(1.0).alias("p")), "i", out).start().awaitTermination()
    assert spark.read.parquet(out).count() == 10
    bad = ST.score_batches(stream(), lambda b: b.filter("i > 0").select("i"), "i", scratch(spark, "out")).start()
    with pytest.raises(Exception):
        bad.awaitTermination()


def test_replay_with_late_answers(spark):
    """Over four batches, features hold the values of earlier batches only; an empty table gives no rows."""
    d = rows(spark).withColumn("b", F.floor(F.col("i") / 30).cast("int"))
    late = ST.late_answers(d, "b", "x")
    make = lambda s: ST.user_history(s, "k", ["t", "i"], "x", "t", [1], 1, answer="late")
    got = {r["i"]: r for r in ST.replay(late, "b", make).collect()}
    held = d.orderBy("t").collect()
    assert len(got) == len(held)
    for r in held:
        past = [q["x"] for q in held if q["k"] == r["k"] and q["b"] < r["b"]]
        assert got[r["i"]]["past_count"] == len(past)
        assert close(got[r["i"]]["past_avg"], sum(past) / len(past) if past else None)
        assert close(got[r["i"]]["past_avg_1"], past[-1] if len(past) > 1 else None)
    assert ST.replay(late.filter("false"), "b", make).count() == 0


def test_saved_state_keeps_the_null_key(spark):
    d = spark.createDataFrame([(None, 1, 1, 2.0), (None, 2, 2, 4.0), ("a", 3, 3, 1.0)], SCHEMA)
    got = {r["k"]: (r["n"], r["mean"], r["tail"]) for r in ST.history_state(d, "k", ["t", "i"], "x", "t", [1], 1).collect()}
    assert got == {None: (2, 3.0, [2.0, 4.0]), "a": (1, 1.0, [1.0])}


def test_history_of_a_key_needs_no_frame_sort(monkeypatch):
    """A stream calls the step once per key and batch: a key's rows in one frame are neither joined nor sorted as a frame."""
    import pandas as pd

    class Held:
        kept = None
        get, update = lambda self: self.kept, lambda self, v: setattr(self, "kept", v)

    h = ST._History(["k"], ["t", "i"], "x", "t", [2], 1, "late")
    h.state = Held()
    rows = pd.DataFrame([("a", 9, 3, math.nan, False), ("a", 2, 1, 4.0, True), ("a", 2, 2, 8.0, True), ("a", 9, 1, math.nan, False), ("a", 8, 5, 6.0, True)], columns=["k", "t", "i", "x", "late"])
    want = [("a", 9, 1, 3, 6.0, 7.0), ("a", 9, 3, 3, 6.0, 7.0)]

    def given():
        out = pd.concat([*h.handleInputRows(("a",), iter([rows]), None)])
        return [*out[["k", "t", "i", "past_count", "past_avg", "past_avg_2"]].itertuples(index=False, name=None)]

    with monkeypatch.context() as m:
        m.setattr(pd.DataFrame, "sort_values", None)
        assert given() == want
    assert h.state.kept[0] == 3 and h.state.kept[3] == [4.0, 8.0, 6.0]
    assert [*h.handleInputRows(("a",), iter([rows[rows["late"]]]), None)] == []  # answers only
    assert h.state.kept[0] == 6


def test_replay_is_one_run(spark, monkeypatch):
    """Each batch is one micro-batch of a single run: its state stores are opened once, not once for each batch."""
    made, paths = [], {}
    monkeypatch.setattr(ST, "scratch", lambda s, n: paths.setdefault(n, scratch(s, n)))
    d = rows(spark).withColumn("b", F.when(F.col("i") >= 5, (F.col("i") % 4 - 2) * 0.5)).repartition(3)  # batches -1.0 to 0.5, and rows without

    def make(s):
        made.append(s)
        return ST.user_history(s, "k", ["t", "i"], "x", "t", [1], 1)

    got = {r["i"]: r["past_count"] for r in ST.replay(d, "b", make).collect()}
    assert len(made) == 1
    commits = spark.read.text(f"{paths['checkpoint']}/commits").select("_metadata.file_name").distinct().collect()
    assert sorted(r["file_name"] for r in commits) == ["0", "1", "2", "3"]
    held = [r for r in d.collect() if r["b"] is not None]
    assert got == {r["i"]: sum(q["k"] == r["k"] and (q["b"], q["t"]) < (r["b"], r["t"]) for q in held) for r in held}


def test_history_of_a_key_with_one_row(spark):
    """A key whose first batch brings one row has no gap yet; it gets them in the batches after."""
    d = spark.createDataFrame([("a", 1, 5, 1.0), ("b", 2, 6, 1.0), ("b", 3, 9, 3.0)], SCHEMA)
    make = lambda s: ST.user_history(s, "k", ["t", "i"], "x", "t", [1], 2)
    got = feed(spark, [d.filter("i < 3"), d.filter("i = 3"), spark.createDataFrame([("b", 4, 16, 5.0)], SCHEMA)], make)
    nul = lambda v: None if v is None or math.isnan(v) else v
    assert {i: (r["past_count"], nul(r["gap_0"]), nul(r["gap_1"])) for i, r in got.items()} == {1: (0, None, None), 2: (0, None, None), 3: (1, None, None), 4: (2, 3.0, None)}


def test_history_with_null_keys_and_times(spark):
    """Rows of the NULL key share a state of their own, other keys keep theirs; a gap beside a NULL time is NULL."""
    first = spark.createDataFrame([("x", None, 1, 5, 1.0), ("x", None, 2, 6, 3.0), ("x", 7, 3, 2, 8.0), ("x", 8, 4, None, 4.0), ("x", 8, 5, 3, 6.0)], "z string, k long, i bigint, t bigint, x double").drop("z").coalesce(1)
    second = spark.createDataFrame([(None, 11, 8, 0.0), (7, 12, 9, 0.0), (8, 13, 9, 0.0), (8, 14, 10, 0.0)], first.schema).coalesce(1)
    got = feed(spark, [first, second], lambda s: ST.user_history(s, "k", ["t", "i"], "x", "t", [1], 2))
    assert {i: (r["k"], r["past_count"], r["gap_0"]) for i, r in got.items()} == {
        1: (None, 0, None), 2: (None, 1, None), 3: (7, 0, None), 4: (8, 1, None), 5: (8, 0, None),
        11: (None, 2, 1.0), 12: (7, 1, None), 13: (8, 2, None), 14: (8, 3, None)}
