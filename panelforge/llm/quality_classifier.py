"""A document classifier inside a hierarchy of sites, by empirical Bayes.

Evidence: the log likelihood ratio of a document's features, from a logistic model of labelled documents. Prior:
the rate of good documents in its path, shrunk towards that of its host, which is shrunk towards the global
rate. How much follows from how far the rates of sites spread beyond chance (method of moments), so sparse
sites lean on the level above. Each document's own share is taken out of its prior.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from panelforge.operators.ordered import attach
from panelforge.session import stored

from .quality_rules import SYMBOLS, _repeated
from .registry import query, table
from .texts import coded_words, slices

MAX_LABELLED = 20_000  # labelled documents that the evidence is fitted on, those of the lowest hashes
BUCKETS = 1 << 17  # of hashed features: the model's size
FIT_PARTS = 6  # the fitted rows are bounded, and each part sends a gradient of the model's size at each step
PENALTY, SPARSE, ITERATIONS = 5e-4, 1.0, 60
MARKS = ".,;:!?\"'()[]{}*#$%&|<>"


def feature_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the different hashes of its features: words in lower case without marks at their ends, and
    classes of length, word length, and shares of symbols, exclamation marks, repeated and different words."""
    for part in slices(texts):
        codes, starts, words = coded_words(part)
        plain = pc.utf8_trim(pc.utf8_lower(words), characters=MARKS)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in plain.to_pylist()], np.uint64).view(np.int64)
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        repeated = _repeated(codes, starts, max(1, len(words)))
        for i, text in enumerate(part.to_pylist()):
            own = codes[starts[i] : starts[i + 1]]
            kinds, n = np.unique(own), max(1, len(own))
            text = text or ""
            classes = (
                ("length", int(np.log2(len(own) + 1))), ("word", int(sizes[own].mean()) if len(own) else 0),
                ("symbols", min(9, sum(map(text.count, SYMBOLS)) * 10 // n)), ("marks", min(9, text.count("!") * 10 // n)),
                ("repeated", int(repeated[i]) * 10 // n), ("different", len(kinds) * 10 // n),
            )
            bins = np.array([xxhash.xxh64_intdigest(f"\n{a}:{b}") for a, b in classes], np.uint64).view(np.int64)
            yield np.unique(np.concatenate([hashes[kinds], bins]))


@arrow_udf(T.ArrayType(T.IntegerType()))
def _buckets(texts: pa.Array) -> pa.Array:
    sets = [_bucket(s) for s in feature_sets(texts)]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).astype(np.int32) if sets else np.zeros(0, np.int32)))


def _bucket(features: np.ndarray) -> np.ndarray:
    return np.unique(features & (BUCKETS - 1))


@F.udf(VectorUDT())
def _vector(buckets):
    return Vectors.sparse(BUCKETS, buckets, [1.0] * len(buckets))


def _scorer(held):
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, start = held.value
        for texts in batches:
            yield pa.array([start + float(weights[_bucket(s)].sum()) for s in feature_sets(texts)], pa.float64())

    return arrow_udf(score, T.DoubleType()).asNondeterministic()


def fit(docs: DataFrame, labels: DataFrame, good: Column, key: str = "doc_id", text: str = "text", limit: int = MAX_LABELLED) -> tuple[np.ndarray, float, float]:
    """(weights, start, rate): a logistic model over BUCKETS hashed features, its log odds less those of ``rate``,
    the share of good labelled documents, so that a sum of weights and ``start`` is a log likelihood ratio.

    ``good`` is a condition on ``labels``; rows where it or the key is NULL are left out, and a document with
    several labels is good only if all are. At most ``limit`` labels are used, those of the lowest hashes, so
    their table is broadcast and the rows to fit are few. Labels without a document are left out. Without
    labels, or with labels of one kind, all weights are 0; the rate is (good + 1) / (n + 2) always.
    """
    marked = labels.select(F.col(key).alias("key"), good.cast("int").alias("good")).filter("key is not null and good is not null")
    used = stored(marked.groupBy("key").agg(F.min("good").alias("good")).orderBy(F.xxhash64("key"), "key").limit(limit))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    met = stored(rows.join(F.broadcast(used), "key").select("good", _buckets("text").alias("buckets"))).coalesce(FIT_PARTS)
    n, n_good = met.agg(F.count(F.lit(1)), F.coalesce(F.sum("good"), F.lit(0))).first()
    rate = (n_good + 1.0) / (n + 2.0)
    if not 0 < n_good < n:
        return np.zeros(BUCKETS), 0.0, rate
    model = LogisticRegression(labelCol="good", featuresCol="x", regParam=PENALTY, elasticNetParam=SPARSE, standardization=False, maxIter=ITERATIONS)
    fitted = model.fit(met.select("good", _vector("buckets").alias("x")))
    return fitted.coefficients.toArray(), float(fitted.intercept - np.log(rate / (1 - rate))), rate


def _spread(sites: DataFrame, mean: Column, name: str) -> DataFrame:
    """One row: the weight of the level above, in documents, from the rates' spread around ``mean`` beyond chance."""
    total = F.sum("n")
    between = (F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)) - F.sum(mean * (1 - mean))) / (total - F.sum(F.col("n") * F.col("n")) / total)
    within = F.sum(F.col("n") * mean * (1 - mean)) / total
    weight = F.when(between > 0, within / between - 1)
    return sites.agg(F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.coalesce(weight, F.lit(1e6)))).alias(name))


def classify(
    docs: DataFrame, labels: DataFrame, good: Column, levels: Sequence[str] = ("source", "lang"), key: str = "doc_id", text: str = "text",
    limit: int = MAX_LABELLED,
) -> DataFrame:
    """One row per row of ``docs``: the key, evidence, prior, posterior and kept (posterior of one half or more).

    ``levels``: host column and the column that cuts a host into paths; NULL is a site of its own. The sites'
    rates are means over all their documents of what the evidence alone says. A document without words
    has the evidence of its length class alone. Repeated rows count as often as they occur. Without labels all
    evidence is 0 and all documents are kept. An empty table gives no rows; other columns are left out.
    """
    weights, start, rate = fit(docs, labels, good, key, text, limit)
    held = docs.sparkSession.sparkContext.broadcast((weights, start))
    host, path = (F.col(f"`{c}`") for c in levels)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = float(np.log(rate / (1 - rate)))
    scored = stored(docs.select(F.col(f"`{key}`").alias("key"), F.struct(host.alias("host")).alias("host"), F.struct(host.alias("host"), path.alias("path")).alias("path"), _scorer(held)(body).alias("evidence")))
    scored = scored.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + base))))
    paths = stored(scored.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy(F.struct("path.host").alias("host")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg((F.sum("s") / F.sum("n")).alias("mean"))
    host_rates = attach(hosts, whole)
    host_weight = _spread(host_rates, F.col("mean"), "host_weight")
    own = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    within = paths.withColumn("host", F.struct("path.host")).join(own, "host")
    path_weight = _spread(within, F.col("host_s") / F.col("host_n"), "path_weight")
    sites = attach(attach(attach(within, whole), host_weight), path_weight)
    met = scored.join(sites.select("path", F.col("n").alias("path_n"), F.col("s").alias("path_s"), "host_n", "host_s", "mean", "host_weight", "path_weight"), "path")
    above = (F.col("host_s") - F.col("p") + F.col("host_weight") * F.col("mean")) / (F.col("host_n") - 1 + F.col("host_weight"))
    prior = (F.col("path_s") - F.col("p") + F.col("path_weight") * above) / (F.col("path_n") - 1 + F.col("path_weight"))
    safe = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    judged = met.withColumn("prior", safe).withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("prior") / (1 - F.col("prior")))))))
    return judged.select(F.col("key").alias(key), "evidence", "prior", "posterior", (F.col("posterior") >= 0.5).alias("kept"))


@query("op5_quality_classifier")
def op5(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return classify(table(spark, sf_dir, "documents"), labels, (F.col("quality") == 1) & (F.col("toxic") == 0))
