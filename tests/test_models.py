"""Models and projections against numpy or their defining properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import aggregates as A, learning as L


def test_tfidf_by_hand(spark):
    docs = [["a", "b", "a"], ["b", "c"], ["b", "a", "b", "d"], []]
    d = spark.createDataFrame([(i, w) for i, w in enumerate(docs)], "i int, w array<string>")
    out, vocab = L.tfidf(d, "i", "w", (1, 2), 4)
    grams = [x + [f"{p} {q}" for p, q in zip(x, x[1:])] for x in docs]
    terms = sorted({g for x in grams for g in x}, key=lambda g: (-sum(x.count(g) for x in grams), g))[:4]
    assert [r["term"] for r in vocab.orderBy(F.desc("total"), "term").collect()] == terms
    df = {v: sum(v in x for x in grams) for v in terms}
    got = {(r["i"], r["term"]): r["weight"] for r in out.collect()}
    for i, x in enumerate(grams):
        raw = np.array([x.count(v) * (math.log(5 / (df[v] + 1)) + 1) for v in terms])
        size = np.linalg.norm(raw)
        np.testing.assert_allclose([got.get((i, v), 0.0) for v in terms], raw / size if size else raw, atol=1e-12)


def test_pca_axes(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(80, 3)) @ np.array([[3.0, 1, 0], [0, 1, 0.5], [0, 0, 0.1]])
    d = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, v array<double>")
    got = np.array([r["pca"] for r in L.pca(d, "v", 2).orderBy("i").collect()])
    _, _, axes = np.linalg.svd(x - x.mean(0))
    want = x @ axes[:2].T
    for j in range(2):
        assert min(np.abs(got[:, j] - want[:, j]).max(), np.abs(got[:, j] + want[:, j]).max()) < 1e-8


def test_topics_and_factors(spark):
    d = spark.createDataFrame([(i, float(5 * (i % 2)), float(5 * (1 - i % 2)), 1.0) for i in range(20)], "i int, a double, b double, c double")
    for r in L.topics(d, ["a", "b", "c"], 2).collect():
        assert sum(r["topics"]) == pytest.approx(1) and min(r["topics"]) >= 0
    m = spark.createDataFrame([(i, j, float(1 + (i % 2) * (j % 2))) for i in range(10) for j in range(6)], "r int, c int, v double")
    big = m.withColumn("r", F.col("r") + 10_000_000_000)  # ids beyond int
    rows, cols = L.nmf(big, "r", "c", "v", 2, iterations=40)
    u = {r["id"] - 10_000_000_000: np.array([r["f0"], r["f1"]]) for r in rows.collect()}
    v = {r["id"]: np.array([r["f0"], r["f1"]]) for r in cols.collect()}
    assert min(x.min() for x in [*u.values(), *v.values()]) >= 0
    assert max(abs(u[r["r"]] @ v[r["c"]] - r["v"]) for r in m.collect()) < 0.3


def test_item_vectors(spark):
    d = spark.createDataFrame([(["a", "b", "c"],), (["b", "c", "a"],)], "s array<string>")
    got = {r["word"]: r["vector"] for r in L.item2vec(d, "s", 5).collect()}
    assert set(got) == {"a", "b", "c"} and all(len(v) == 5 for v in got.values())


def test_stacking_leaves_out_the_own_fold(spark):
    r = np.random.default_rng(2)
    n = 90
    fold, p, q = np.arange(n) % 3, r.normal(size=n), r.normal(size=n)
    y = 0.6 * p + 0.3 * q + r.normal(size=n) * 0.1
    d = spark.createDataFrame([(int(i), int(f), float(a), float(b), float(t)) for i, (f, a, b, t) in enumerate(zip(fold, p, q, y))], "i int, fold int, p double, q double, y double")
    got = np.array([r["stacked"] for r in L.stack_ridge(d, ["p", "q"], "y", "fold", alpha=1.5).orderBy("i").collect()])
    x = np.column_stack([p, q])
    for f in range(3):
        tr = fold != f
        mx, my = x[tr].mean(0), y[tr].mean()
        w = np.linalg.solve((x[tr] - mx).T @ (x[tr] - mx) + 1.5 * np.eye(2), (x[tr] - mx).T @ (y[tr] - my))
        np.testing.assert_allclose(got[~tr], my + (x[~tr] - mx) @ w, rtol=1e-8)


def test_blend_and_row_stats(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "i int, p double")
    b = spark.createDataFrame([(1, 3.0), (2, 6.0)], "i int, p double")
    assert {r["i"]: r["p"] for r in A.blend([a, b], "i", "p", [0.75, 0.25]).collect()} == {1: 1.5, 2: 3.0}
    s = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double").withColumns(A.row_stats(["a", "b", "c"])).collect()
    assert (s[0]["row_mean"], s[0]["row_median"], s[0]["row_std"]) == (2.0, 2.0, pytest.approx(math.sqrt(2))) and s[1]["row_mean"] is None


def test_constant_column_scales_to_zero(spark):
    d = spark.createDataFrame([(2.0,), (2.0,)], "a double")
    assert [r["a"] for r in L.standard_scale(d, ["a"]).collect()] == [0.0, 0.0] == [r["a"] for r in L.minmax_scale(d, ["a"]).collect()]
    assert d.agg(F.count("a")).first()[0] == 2


def test_blended_errors_at_half_bins_are_those_of_the_sql(spark, tmp_path):
    """Errors that end in 5 go to the even bin, so the blend must not be off by a last bit."""
    import duckdb

    from compare import rows
    from panelforge.plans import ORACLE, QUERIES

    i = F.col("id")
    d = spark.range(40_000).select(i.alias("o_orderkey"), (i * 7).alias("o_custkey"), (i % 37 * 1000 + i % 10 * 100).cast("double").alias("o_totalprice"))
    d.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = QUERIES["blended_predictions"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    res = con.execute(ORACLE["blended_predictions"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([c[0] for c in res.description], res.fetchall())


def test_tfidf_shuffles_terms_of_few_cells_only(spark, monkeypatch):
    """Terms are counted by name in the heaviest cells; few cells, that hold many terms, give the same vocabulary and weights."""
    docs = [(i, [f"w{i * 13 + j}" for j in range(30)] + ["a", "b", "a", "b"] * (1 + i % 3)) for i in range(60)]
    d = spark.createDataFrame(docs, "i int, w array<string>")
    sizes, kept = [], L.stored
    monkeypatch.setattr(L, "stored", lambda t: (lambda k: (sizes.append(k.count() if "tf" in k.columns else 0), k)[1])(kept(t)))

    def made():
        out, vocab = L.tfidf(d, "i", "w", (1, 2), 3)
        return sorted((r["i"], r["term"], round(r["weight"], 12)) for r in out.collect()), sorted(tuple(r)[:3] for r in vocab.collect())

    many = made()
    assert many[1] == [("a", 240, 60), ("a b", 240, 60), ("b", 240, 60)]
    assert 0 < sum(sizes) < 3_000  # of 3,900 (document, term) rows
    monkeypatch.setattr(L, "TERM_CELLS", 2)
    assert made() == many
    binary = L.tfidf(d, "i", "w", (1, 1), 2, binary=True)[1].collect()
    assert sorted((r["term"], r["total"], r["df"]) for r in binary) == [("a", 60, 60), ("b", 60, 60)]


def test_topics_compute_the_rows_once(spark):
    """Every step reads the rows; what makes them runs once."""
    n = spark.sparkContext.accumulator(0)

    def made(batches):
        for b in batches:
            n.add(len(b))
            yield b

    d = spark.range(50).select("id", (F.col("id") % 5 + 1.0).alias("a"), F.lit(2.0).alias("b")).mapInPandas(made, "id bigint, a double, b double")
    out = L.topics(d, ["a", "b"], 2, iterations=3)
    assert n.value == 50 and out.count() == 50 and len(out.collect()[0]["topics"]) == 2 and n.value == 50


def test_factor_cells_are_added_up_in_parts_of_bounded_size(spark, monkeypatch):
    d = spark.range(400).select((F.col("id") % 20).alias("r"), (F.col("id") % 7).alias("c"), F.lit(1).alias("v"))
    want = sorted(map(tuple, L.nmf(d, "r", "c", "v", 2, iterations=1)[0].collect()))
    monkeypatch.setattr(L, "CELL_ROWS", 10)
    plans, kept = [], L.stored
    monkeypatch.setattr(L, "stored", lambda t: (plans.append(t._jdf.queryExecution().toString()), kept(t))[1])
    got = sorted(map(tuple, L.nmf(d, "r", "c", "v", 2, iterations=1)[0].collect()))
    assert "40), REPARTITION_BY_NUM" in plans[0]
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(a - b) < 1e-9 for g, w in zip(got, want) for a, b in zip(g[1:], w[1:]))
