"""Edge cases worked out by hand, cross-checks against pandas, and invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import scalars as S, text as X
from panelforge.operators import aggregates as A, candles as C, cleaning as L, encoding as E, joins as J, learning as G, metrics as M
from panelforge.operators import ranking as R, reshape as H, sequences as Q, splitting as V, windows as N
from panelforge.sources import sensors as SE


def col(df, name, by="t"):
    return [r[name] for r in df.orderBy(by).collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def series(spark):
    r = np.random.default_rng(0)
    p = pd.DataFrame({"k": r.integers(0, 5, 300), "t": np.arange(300), "x": r.normal(size=300).round(3)})
    return p, spark.createDataFrame(p)


def test_single_row_entity(spark):
    d = spark.createDataFrame([("a", 1, 5.0)], "k string, t int, x double")
    p = A.profile_deltas(A.numeric_profile(d, "k", "t", "x"), "x").first()
    assert p["x_std"] is None and p["x_first"] == p["x_last"] == 5.0 and p["x_last_first_sub"] == 0
    assert A.last_diff(d, "k", "t", "x").first()["x_last_diff"] is None
    assert A.mean_before_last(d, "k", "t", "x", [2]).first()["x_mean_before_2"] is None
    assert col(N.lags(d, "k", "t", "x", [1]), "x_lag_1") == [None]


def test_last_skips_null_and_scale_skips_leading_zeros(spark):
    d = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.0), ("a", 3, 4.0), ("a", 4, 6.0), ("a", 5, None)], "k string, t int, x double")
    assert A.numeric_profile(d, "k", "t", "x").first()["x_last"] == 6.0
    assert A.series_scale(d, "k", "t", "x").first()["scale"] == 4.0


def test_pandas_windows(series):
    p, d = series
    g = p.groupby("k")["x"]
    out = N.rolling(d, "k", "t", "x", [12], ["skew", "kurt", "median", "std"])
    out = N.ewm(out, "k", "t", "x", 0.4)
    got = out.orderBy("t").toPandas()
    for name, want in {
        "x_skew_12": g.transform(lambda s: s.rolling(12).skew()), "x_kurt_12": g.transform(lambda s: s.rolling(12).kurt()),
        "x_median_12": g.transform(lambda s: s.rolling(12).median()), "x_std_12": g.transform(lambda s: s.rolling(12).std()),
        "x_ewm": g.transform(lambda s: s.ewm(alpha=0.4).mean()),
    }.items():
        np.testing.assert_allclose(got[name].astype(float), want, atol=1e-9)


def test_pandas_slope_and_rank(series):
    p, d = series
    got = N.rolling_slope(d, "k", "t", "x").orderBy("t").toPandas()
    fit = lambda w: np.polyfit(np.arange(len(w)), w, 1)[0]
    want = p.groupby("k")["x"].transform(lambda s: s.rolling(12, min_periods=9).apply(fit, raw=True))
    np.testing.assert_allclose(got["x_slope_12"].astype(float), want, atol=1e-9)
    tied = d.withColumn("x", F.round("x", 0))
    want = p.assign(x=p["x"].map(lambda v: float(np.floor(abs(v) + 0.5) * np.sign(v)))).groupby("k")["x"].rank()
    np.testing.assert_allclose(N.rank_avg(tied, "k", "x").orderBy("t").toPandas()["rank"], want)


def test_constant_series_has_no_correlation(spark):
    d = spark.range(12).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.lit(2.0).alias("x"))
    assert set(col(N.rolling_slope(d, "k", "t", "x"), "x_corr_12")) == {None}


def test_ewm_with_null_keeps_age(spark):
    p = pd.Series([1.0, None, 3.0, None, 5.0])
    d = spark.createDataFrame([(1, i, None if pd.isna(v) else v) for i, v in enumerate(p)], "k int, t int, x double")
    np.testing.assert_allclose(np.array(col(N.ewm(d, "k", "t", "x", 0.5), "x_ewm"), float), p.ewm(alpha=0.5).mean())


def test_past_windows_do_not_leak(series):
    _, d = series
    early = d.filter("t < 150")
    make = lambda x: N.recent_past(N.past_gaps(x, "k", "t", "t", 2), "k", "t", "x", [5]).filter("t < 150").orderBy("t").collect()
    assert make(d) == make(early)


def test_divisions(spark):
    assert one(spark, S.safe_div(F.lit(1), F.lit(0))) is None and one(spark, S.div0(F.lit(1.0), F.lit(0))) == 0.0
    d = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.0), ("a", 3, 5.0), ("a", 4, 4.0)], "k string, t int, x double")
    assert col(N.change_ratio(d, "k", "t", "x"), "x_change") == pytest.approx([None, 0.0, 1.0, 0.2])
    z = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0)], "y double, p double")
    assert M.smape(z, "y", "p").first()["smape"] == pytest.approx(50.0)


def test_rounding_is_half_even(spark):
    assert one(spark, S.round_to(F.lit(12.5), 5)) == round(12.5 / 5) * 5
    assert one(spark, S.round_bin(F.lit(2.5))) == 2.0


def test_replay_and_ties(spark):
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate([0, 1, 2, 0, 1, 3])] + [("b", 0, 1), ("b", 1, 1)], "k string, t int, level int")
    kept = L.drop_after_regression(d, "k", "t", "level")
    assert sorted((r["k"], r["t"]) for r in kept.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    s = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0)], "k string, t int, x double")
    assert A.argmax_row(s, "k", "x", "t").first()["t"] == 1


def test_auc_with_ties_and_map_with_repeats(spark):
    d = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert M.auc(d, "y", "p").first()["auc"] == pytest.approx(3.5 / 4)
    m = spark.createDataFrame([([1, 1, 2, 9], [1, 2, 3])], "pred array<int>, target array<int>")
    assert M.map_at_k(m, "pred", "target").first()["map"] == pytest.approx((1 + 2 / 3) / 3)


def test_padding(spark):
    a = lambda n: F.array(*[F.lit(i) for i in range(1, n + 1)])
    assert [one(spark, Q.pad_left(a(n), 3, 0)) for n in (2, 3, 4)] == [[0, 1, 2], [1, 2, 3], [2, 3, 4]]
    assert [one(spark, Q.pad_right(a(n), 3, 0)) for n in (2, 3, 4)] == [[1, 2, 0], [1, 2, 3], [1, 2, 3]]
    assert one(spark, Q.shift_right(a(3), 9)) == [9, 1, 2]


def test_votes_break_ties_by_first_seen(spark):
    d = spark.createDataFrame([([3, 1], [2, 1])], "a array<int>, b array<int>")
    assert d.select(R.vote_lists(["a", "b"], [1, 1], 3).alias("v")).first()["v"] == [1, 3, 2]


def test_negative_samples_are_new_and_complete(spark):
    pos = spark.createDataFrame([(u, i) for u in range(6) for i in range(u + 1)] + [(9, i) for i in range(10)], "u int, i int")
    out = R.negative_samples(pos, "u", "i", 4).collect()
    own = {(r["u"], r["i"]) for r in pos.collect()}
    assert not own & {(r["u"], r["i"]) for r in out} and len({tuple(r) for r in out}) == len(out)
    assert {u: sum(r["u"] == u for r in out) for u in (0, 5, 9)} == {0: 4, 5: 4, 9: 0}


def test_group_folds_balance_and_keep_groups_whole(spark):
    sizes = [17, 5, 5, 5, 4, 4, 4, 3, 1, 1, 1, 1, 1]
    d = spark.createDataFrame([(g, j) for g, n in enumerate(sizes) for j in range(n)], "g int, j int")
    got = {}
    for r in V.group_fold(d, "g", 3).collect():
        assert got.setdefault(r["g"], r["fold"]) == r["fold"]
    loads, want = [0, 0, 0], {}
    for g, n in sorted(enumerate(sizes), key=lambda v: (-v[1], v[0])):
        want[g] = loads.index(min(loads))
        loads[want[g]] += n
    assert got == want


def test_stratified_group_fold_keeps_groups_whole(spark):
    d = spark.range(400).select((F.col("id") % 37).alias("g"), (F.col("id") % 37 % 2).alias("y"))
    assert V.stratified_group_fold(d, "y", "g", 4).groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n <> 1").count() == 0


def test_category_seen_in_one_fold_only(spark):
    d = spark.createDataFrame([("a", 1, 0), ("a", 0, 0), ("b", 1, 1), ("b", 1, 0)], "c string, y int, fold int")
    got = {(r["c"], r["fold"]): r["te"] for r in E.target_encode(d, "c", "y", "fold", 10.0, name="te").collect()}
    assert got[("a", 0)] == pytest.approx(0.75)  # no other fold: the overall mean


def test_snap_and_bins(spark):
    assert J.snap_nearest(spark.createDataFrame([(0.5,)], "x double"), "x", [0, 1]).first()["x_snapped"] == 0.0
    d = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    want = pd.cut(pd.Series(range(11)), 5, labels=False).tolist()
    assert col(L.equal_width_bin(d, "x", 5), "bin", "x") == want


def test_lines_with_two_records(spark, tmp_path):
    f = tmp_path / "s" / "f" / "p.txt"
    f.parent.mkdir(parents=True)
    f.write_text("#\tstartTime:1\n1560000000001\tTYPE_WAYPOINT\t1.5\t2.5\n1560000000002\tTYPE_WAYPOINT\t3.0\t4.01560000000003\tTYPE_ACCELEROMETER\t1\t2\t3\t2\n")
    got = SE.read_sensor_text(spark, str(tmp_path))
    assert sorted((r["timestamp"], r["x"], r["y"]) for r in got["waypoint"].collect()) == [(1560000000001, 1.5, 2.5), (1560000000002, 3.0, 4.0)]
    a = SE.with_path_parts(got["accelerometer"], ["site", "floor", "file"]).first()
    assert (a["timestamp"], a["z"], a["site"], a["floor"], a["file"]) == (1560000000003, 3.0, "s", "f", "p")


def test_text(spark):
    t = 'He said "a cat". Then... A CAT sat.'
    assert one(spark, X.quotes_found(F.lit(t), F.lit("a cat was here"))) == 1
    assert one(spark, X.dots_count(F.lit(t))) == 1
    assert one(spark, X.ngram_overlap(F.lit("a b c d"), F.lit("b c d"), 2)) == 2
    assert one(spark, X.ngram_overlap(F.lit("a"), F.lit("b c d"), 3)) == 0
    assert one(spark, X.word_overlap(F.lit("the cat sat"), F.lit("the cat ran"))) == 1
    r = spark.range(1).select(*[c.alias(n) for n, c in X.readability(F.lit("The cat sat on the mat. It was happy.")).items()]).first()
    assert r["syllables"] == 10 and r["lix"] == pytest.approx(4.5)


def test_bbox_of_both_depths(spark):
    d = spark.createDataFrame([("[[[1,2],[3.5,-4]]]",), ("[[[[0,0],[1,1]]],[[[-2e1,5],[7,8]]]]",)], "coordinates string")
    assert [tuple(r)[1:] for r in SE.bbox(d).collect()] == [(1.0, 3.5, -4.0, 2.0), (-20.0, 7.0, 0.0, 8.0)]


def test_ridge_matches_numpy(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + r.normal(size=200) * 0.1
    d = spark.createDataFrame([(0, *map(float, a), float(b)) for a, b in zip(x, y)], "k int, a double, b double, c double, y double")
    got = G.ridge_fit(d, "k", ["a", "b", "c"], "y", 2.0).first()["coef"]
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(got, [y.mean() - x.mean(0) @ w, *w], rtol=1e-8)


def test_pca_shape_and_scale(spark):
    d = spark.createDataFrame([(float(i), float(2 * i), float(i % 3)) for i in range(20)], "a double, b double, c double")
    assert len(G.pca(d, ["a", "b", "c"], 2).first()["pca"]) == 2
    s = G.standard_scale(d, ["a"]).agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s")).first()
    assert s["m"] == pytest.approx(0) and s["s"] == pytest.approx(1)


def test_stages_and_intervals(spark):
    d = spark.createDataFrame([("a", "start", 1), ("a", "end", 2), ("a", "start", 5), ("a", "end", 9)], "k string, e string, t int")
    assert sorted((r["start"], r["end"]) for r in H.to_intervals(d, "k", "t", "e", "t").collect()) == [(1, 2), (5, 9)]


def test_long_ranges_and_pieces(spark):
    d = spark.createDataFrame([("a", 0, 1.0), ("a", 25_000, 2.0)], "k string, t bigint, x double")
    out = J.complete_range(d, "k", "t", pad="x")
    assert out.count() == 25_001 and out.filter("x = 1.0").count() == 25_000
    s = Q.sequences(spark.range(10).withColumn("k", F.lit(1)).withColumn("v", F.col("id")), "k", "id", "v", chunk=4)
    assert [r["v"] for r in s.orderBy("piece").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]


def test_validation_finds_mistakes(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (5,)], "i int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "i int")
    r = M.validate_batch(a, b, "i").first()
    assert (r["predicted"], r["expected"], r["missing"], r["unexpected"], r["repeated"]) == (4, 3, 1, 1, 1)


def test_pieces_share_batches(spark):
    """A task hands its pieces to the function from common batches; a NULL in one piece leaves the numbers of the others whole."""
    big = 2**53 + 1
    d = spark.createDataFrame([(k, i, None if k == 7 else big) for k in [None, 0, *range(3, 12)] for i in range(5)], "k bigint, i bigint, n bigint").repartition(1)

    def seen(pdf):
        assert pdf["i"].is_monotonic_increasing and len(pdf) <= 2 and pdf.index[0] == 0
        return pdf.assign(rows=len(pdf), first=int(pdf["i"].iloc[0]))

    out = Q.apply_by_piece(d, "k", "i", seen, "k bigint, i bigint, n bigint, rows int, first int", 2)
    assert "MapInPandas" in out._jdf.queryExecution().toString() and "FlatMapGroups" not in out._jdf.queryExecution().toString()
    got = out.collect()
    assert sorted([(r["k"], r["i"], r["n"], r["rows"], r["first"]) for r in got], key=repr) == sorted(
        [(k, i, None if k == 7 else big, 1 if i == 4 else 2, i // 2 * 2) for k in [None, 0, *range(3, 12)] for i in range(5)], key=repr)
