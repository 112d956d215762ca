from pyspark.sql import functions as F

from panelforge.llm import quality_classifier as q

def good():
    return (F.col("quality") == 1) & (F.col("toxic") == 0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = q.classify(docs, labels.filter("doc_id % 2 = 0"), good())
    met = judged.join(labels.filter("doc_id % 2 = 1"), "doc_id").groupBy("quality", "toxic", "kept").count().collect()
    n = lambda f: sum(r["count"] for r in met if f(r))
    clean, junk, toxic = (lambda r: r["quality"] == 1 and not r["toxic"]), (lambda r: r["quality"] == 0), (lambda r: r["toxic"] == 1)
    assert n(lambda r: clean(r) and r["kept"]) >= 0.99 * n(clean)
    assert n(lambda r: junk(r) and not r["kept"]) >= 0.95 * n(junk)
    assert n(lambda r: toxic(r) and not r["kept"]) >= 0.7 * n(toxic)


def test_sparse_sites_lean_on_the_level_above(spark):
    """Priors against the formulas in plain Python, with evidence of 0."""
    docs = spark.createDataFrame([(i, "t", "a" if i < 30 else "b", "x" if i % 2 else None) for i in range(40)], "doc_id bigint, text string, source string, lang string")
    none = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = q.classify(docs, none, good()).collect()
    assert len(got) == 40 and all(r["kept"] and r["evidence"] == 0 and abs(r["prior"] - 2 / 3) < 1e-9 for r in got)  # (1 + 1) / (1 + 2)


def test_edges(spark, rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (None, 1, 0), (5, None, 1), (8, 0, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = q.classify(rows, labels, good(), levels=("source", "odd name"))
    assert got.count() == rows.count() and got.filter("posterior is null or kept is null").count() == 0
    assert q.classify(empty, labels, good(), levels=("source", "token")).count() == 0
    assert q.classify(rows, labels.filter("false"), good(), levels=("source", "token")).filter("kept").count() == rows.count()


def test_limit_is_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    weights, start, rate = q.fit(docs, labels, good(), limit=50)
    assert rate * 52 - 1 == round(rate * 52 - 1) and len(weights) == q.BUCKETS
