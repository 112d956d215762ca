"""Scaling, projections and linear models on Spark.

Linear fits need only sums of products per segment; the small solve follows them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import PCA, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from .ordered import attach, listed, same_keys
from .cleaning import label_map
from .reshape import union

CELL_ROWS = 1_000_000  # rows of a task that adds up the cells of ``nmf``
TERM_CELLS = 1 << 20  # cells of the first count of ``tfidf``; any number gives the same result


def scale_fit(df, cols, how="standard"):
    """Centre and width per column as one row: mean and population deviation, or min and range."""
    aggs = []
    for c in listed(cols):
        centre, width = (F.avg(c), F.stddev_pop(c)) if how == "standard" else (F.min(c), F.max(c) - F.min(c))
        aggs += [centre.alias(f"_c_{c}"), width.alias(f"_w_{c}")]
    return df.agg(*aggs)


def scale_apply(df, fitted, cols):
    """Scaled columns; a constant column becomes 0."""
    out = df.transform(attach, fitted)
    scaled = {c: (F.col(c) - F.col(f"_c_{c}")) / F.when(F.col(f"_w_{c}") == 0, 1.0).otherwise(F.col(f"_w_{c}")) for c in listed(cols)}
    return out.withColumns(scaled).drop(*[c for c in fitted.columns])


def standard_scale(df, cols):
    return scale_apply(df, scale_fit(df, cols), cols)


def minmax_scale(df, cols):
    return scale_apply(df, scale_fit(df, cols, "minmax"), cols)


def _vector(df, cols, name="_vec"):
    cols = listed(cols)
    if len(cols) == 1 and df.schema[cols[0]].dataType.typeName() == "array":
        return df.withColumn(name, array_to_vector(F.transform(cols[0], lambda x: x.cast("double"))))
    return VectorAssembler(inputCols=cols, outputCol=name).transform(df)


def pca(df, cols, k, name="pca"):
    """Projection on the k main axes of number columns or one array column."""
    d = _vector(df, cols)
    model = PCA(k=k, inputCol="_vec", outputCol="_pca").fit(d)
    return model.transform(d).withColumn(name, vector_to_array("_pca")).drop("_vec", "_pca")


def tfidf(df, keys, words, ngrams=(1, 1), max_features=512, binary=False):
    """Tf-idf of word n-grams as rows (keys, term, weight), and the vocabulary (term, total, df, idf).

    The vocabulary holds the ``max_features`` most frequent terms, ties by the term. A term weighs its count
    (``binary``: 1) times ln((1 + n) / (1 + df)) + 1 over n documents; a document's weights have length 1.
    ``words`` is an array column; a document without a term of the vocabulary gives no row.

    Occurrences are counted per hash cell first; terms themselves are counted, exactly, only in cells that can hold one of the vocabulary.
    """
    keys, (lo, hi) = listed(keys), ngrams
    w = F.col(words)

    def grams(make):
        def runs(n):
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: make(F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)])))

        return F.explode(F.concat(*[runs(n) for n in range(lo, hi + 1)]))

    def cell(term):
        return F.pmod(F.xxhash64(term), F.lit(TERM_CELLS)).cast("int")

    def counted(held):
        """Counts per keys and term of the terms in the cells of a small table."""
        d = df.select(*keys, grams(lambda x: F.struct(cell(x).alias("_cell"), x.alias("term"))).alias("_g")).select(*keys, "_g.*")
        tf = d.join(F.broadcast(held.select("_cell")), "_cell", "left_semi").groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
        return stored(tf.withColumn("tf", F.lit(1)) if binary else tf)

    def heaviest(tf):
        return tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("total"), "term").limit(max_features)

    # a term occurs no more often than its cell does, so a cell below the last term chosen so far holds none to choose
    load = stored(df.select(grams(cell).alias("_cell")).groupBy("_cell").agg(F.count(F.lit(1)).alias("_load")))
    first = stored(load.orderBy(F.desc("_load"), "_cell").limit(4 * max_features))
    counts = counted(first)
    least = heaviest(counts).agg(F.when(F.count(F.lit(1)) >= max_features, F.min("total")).otherwise(0).alias("_least"))
    rest = load.transform(attach, least).filter(F.col("_load") >= F.col("_least"))
    rest = stored(rest.join(F.broadcast(first), "_cell", "left_anti").select("_cell"))
    if not rest.isEmpty():
        counts = counts.unionByName(counted(rest))
    terms = heaviest(counts)
    vocab = terms.transform(attach, df.agg(F.count(F.lit(1)).alias("_docs")))
    vocab = vocab.select("term", "total", "df", (F.log((1 + F.col("_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(F.broadcast(vocab.select("term", "idf")), "term").select(*keys, "term", (F.col("tf") * F.col("idf")).alias("weight"))
    size = raw.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_size"))
    return same_keys(raw, size, keys, "inner").select(*keys, "term", (F.col("weight") / F.col("_size")).alias("weight")), vocab


def topics(df, cols, k, seed=0, iterations=10, name="topics", share=1.0):
    """Topic mixture of count columns or one count vector column.

    Each step fits a ``share`` of the rows; with the default every row is used in every step.
    The rows are stored first, dealt over all slots: each step reads them again, and its work per row is heavy.
    """
    df = stored(df.repartition(df.sparkSession.sparkContext.defaultParallelism))
    d = df.withColumnRenamed(cols, "_vec") if isinstance(cols, str) and df.schema[cols].dataType.typeName() == "vectorudt" else _vector(df, cols)
    model = LDA(k=k, seed=seed, maxIter=iterations, subsamplingRate=share, featuresCol="_vec", topicDistributionCol="_mix").fit(d)
    return model.transform(d).withColumn(name, vector_to_array("_mix")).drop("_mix", "_vec")


def nmf(df, row, col, value, k, iterations=10):
    """Non-negative factors of a sparse matrix given as (row, column, value): tables (id, f0, f1, ...) of rows and columns.

    Cells that are not given are 0 and count. Multiplicative updates; the zeros enter through the k x k Gram
    sums of the other side, so only given cells are joined. The start is fixed: factor i of id x is
    1 + ((7 x + 3 i) mod 11) / 11 for whole ids, so two runs agree. Ids are kept as they are.
    """
    given = df.select(F.col(row).alias("r"), F.col(col).alias("c"), F.col(value).cast("double").alias("v"))
    parts = max(given.sparkSession.sparkContext.defaultParallelism, -(-given.count() // CELL_ROWS))  # so a task's table of cells is bounded
    cells = given.repartition(parts, "r", "c").groupBy("r", "c").agg(F.sum("v").alias("v"))
    names = [f"f{i}" for i in range(k)]

    def begin(side):
        return cells.select(F.col(side).alias("id")).distinct().select("id", *[(1 + F.pmod(F.col("id") * 7 + 3 * i, F.lit(11)) / 11.0).alias(n) for i, n in enumerate(names)])

    def step(mine, own, other, their):
        met = cells.join(other.withColumnRenamed("id", their), their)
        top = met.groupBy(F.col(own).alias("id")).agg(*[F.sum(F.col("v") * F.col(n)).alias(f"_t{i}") for i, n in enumerate(names)])
        gram = other.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"_g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)])
        d = mine.join(top, "id").transform(attach, gram)
        below = [sum((F.col(a) * F.col(f"_g{j}_{i}") for j, a in enumerate(names)), F.lit(1e-12)) for i in range(k)]
        return d.select("id", *[(F.col(n) * F.col(f"_t{i}") / below[i]).alias(n) for i, n in enumerate(names)])

    cells = stored(cells)
    rows, cols = stored(begin("r")), stored(begin("c"))
    for _ in range(iterations):
        rows = stored(step(rows, "r", cols, "c"))
        cols = stored(step(cols, "c", rows, "r"))
    return rows, cols


def item2vec(df, seq, dim, window=5, min_count=1, seed=0, iterations=1, partitions=None):
    """Item vectors learnt from sequences of item names, as (word, vector array).

    Trained on ``partitions`` parts of the data at once (default: those of ``df``), whose weights are averaged
    after each iteration. The vocabulary, items that occur ``min_count`` times, is held by the driver.
    """
    parts = partitions or max(1, df.rdd.getNumPartitions())
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, seed=seed, maxIter=iterations, numPartitions=parts, inputCol=seq, outputCol="_v").fit(df)
    return model.getVectors().withColumn("vector", vector_to_array("vector"))


def _moments(df, keys, xs, y):
    """Sums of products of (1, xs..., y) per key: all a linear fit needs."""
    terms = ["_one", *xs, y]
    d = df.withColumn("_one", F.lit(1.0)).dropna(subset=[*xs, y])
    pairs = [(a, b) for i, a in enumerate(terms) for b in terms[i:]]
    sums = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"_m{i}") for i, (a, b) in enumerate(pairs)]
    return d.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"_m{i}" for i in range(len(pairs))]).alias("_m"))


def _solve(size: int, alpha: float):
    """Ridge coefficients, intercept first and unpenalized, from the packed sums."""

    @F.pandas_udf("array<double>")
    def solve(packed: pd.Series) -> pd.Series:
        out = []
        upper = np.triu_indices(size)
        for m in packed:
            full = np.zeros((size, size))
            full[upper] = m
            full = full + np.triu(full, 1).T
            a, b = full[:-1, :-1].copy(), full[:-1, -1]
            a[np.arange(1, size - 1), np.arange(1, size - 1)] += alpha
            out.append(np.linalg.lstsq(a, b, rcond=None)[0].tolist())
        return pd.Series(out)

    return solve


def ridge_fit(df, keys, xs, y, alpha=1.0):
    """Ridge coefficients per key as an array, the intercept first."""
    keys, xs = listed(keys), listed(xs)
    return _moments(df, keys, xs, y).select(*keys, _solve(len(xs) + 2, alpha)("_m").alias("coef"))


def linear(xs):
    """Prediction from the ``coef`` column."""
    out = F.get("coef", F.lit(0))
    for i, x in enumerate(listed(xs)):
        out = out + F.get("coef", F.lit(i + 1)) * F.col(x)
    return out


def fit_by_segment(df, keys, xs, y, alpha=1.0, name="prediction"):
    """One linear model per segment and its prediction for every row; the coefficients are far fewer than the rows."""
    keys = listed(keys)
    return same_keys(df, ridge_fit(df, keys, xs, y, alpha), keys, "left").withColumn(name, linear(xs)).drop("coef")


def stack_ridge(df, preds, y, fold, by=None, alpha=1.0, name="stacked"):
    """Out-of-fold blend of predictions: each fold (and level) gets the ridge fitted on the other folds.

    Sums of products of the other folds are the totals less the own fold's.
    """
    by, preds = listed(by or []), listed(preds)
    own = _moments(df, [*by, fold], preds, y)
    long = own.select(*by, fold, F.posexplode("_m").alias("_i", "_x"))
    total = long.groupBy(*by, "_i").agg(F.sum("_x").alias("_t"))
    rest = same_keys(long, total, [*by, "_i"], "inner").withColumn("_r", F.col("_t") - F.col("_x"))
    packed = rest.groupBy(*by, fold).agg(F.sort_array(F.collect_list(F.struct("_i", "_r"))).alias("_a"))
    packed = packed.select(*by, fold, F.transform("_a", lambda v: v["_r"]).alias("_m"))
    coef = packed.select(*by, fold, _solve(len(preds) + 2, alpha)("_m").alias("coef"))
    return same_keys(df, coef, [*by, fold], "left").withColumn(name, linear(preds)).drop("coef")


def top_features(dfs: list[DataFrame], n, feature="feature", importance="importance"):
    """The n features of highest mean importance; ties by name."""
    mean = union(*dfs).groupBy(feature).agg(F.avg(importance).alias(importance))
    return mean.orderBy(F.desc(importance), feature).limit(n)
