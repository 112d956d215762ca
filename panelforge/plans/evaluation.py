"""Queries on encodings, folds, time splits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encoding as E, metrics as M, ordered as O, ranking as K, splitting as V
from ..session import stored
from .catalog import Tables, query
from .panel import EV, log
from .profiles import DIMS, LEVELS, SALES, level_union, sales

# encodings


def coded(t: Tables):
    """Orders with a 0/1 target, a rounded price and a fold by key."""
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.floor(F.col("o_totalprice") / 50_000).alias("cat"), (F.col("o_orderkey") % 5).alias("fold"), (F.col("o_totalprice") / 1000).alias("price"))


CODED = """c AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderstatus = 'F' AS INT) AS y, CAST(floor(o_totalprice / 50000) AS BIGINT) AS cat, o_orderkey % 5 AS fold, o_totalprice / 1000 AS price FROM orders)"""


@query("target_group_stats", "E1", f"""
WITH {CODED}, s AS (SELECT *, avg(y) OVER (PARTITION BY o_custkey) AS e, avg(y) OVER (PARTITION BY cat) AS cat_mean, stddev_samp(y) OVER (PARTITION BY cat) AS cat_std,
  avg(y) OVER (PARTITION BY cat, o_orderpriority) AS both_mean, stddev_samp(y) OVER (PARTITION BY cat, o_orderpriority) AS both_std FROM c)
SELECT o_orderkey, cat_mean, cat_std, both_mean, both_std, CAST(e > cat_mean AS INT) AS cat_above, CAST(e > both_mean AS INT) AS both_above FROM s""",
       "cat_mean cat_std both_mean both_std", "cat_above both_above")
def target_group_stats(t):
    d = E.group_target_stats(coded(t), {"cat": ["cat"], "both": ["cat", "o_orderpriority"]}, "y", "o_custkey")
    return d.drop("o_custkey", "o_orderpriority", "y", "cat", "fold", "price")


@query("target_encoding", "E2 S20", f"""
WITH {CODED}, m AS (SELECT avg(y) AS m FROM c), f AS (SELECT cat, fold, sum(y) AS s, count(*) AS n FROM c GROUP BY 1, 2),
t AS (SELECT cat, sum(s) AS s, sum(n) AS n FROM f GROUP BY 1)
SELECT o_orderkey, (t.s - f.s + 10 * m) / (t.n - f.n + 10) AS oof, f.s / f.n AS within, (t.s + 20 * m) / (t.n + 20) AS overall
FROM c JOIN f ON c.cat = f.cat AND c.fold = f.fold JOIN t ON c.cat = t.cat, m""", "oof within overall")
def target_encoding(t):
    c = coded(t)
    d = E.target_encode(c, "cat", "y", "fold", 10.0, name="oof")
    d = E.target_encode(d, "cat", "y", "fold", mode="within", name="within")
    return E.target_apply(d, E.target_fit(c, "cat", "y", 20.0), "cat", "overall_te").select("o_orderkey", "oof", "within", F.col("overall_te").alias("overall"))


@query("pair_encoding", "E3", """
WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 5 AS fold, l_returnflag AS a, l_linestatus AS b, CAST(l_quantity AS INT) % 4 AS c, CASE WHEN l_discount > 0.07 THEN 1.0 WHEN l_discount < 0.03 THEN 0.0 ELSE 0.5 END AS u FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, """ + ", ".join(
    f"avg(CAST({cond} AS INT)) OVER (PARTITION BY fold, {p}, {q}) AS {p}_{q}_{n}" for p, q in (("a", "b"), ("a", "c"), ("b", "c"))
    for n, cond in (("one", "u = 1"), ("zero", "u = 0"), ("between", "u > 0 AND u < 1"))) + " FROM g",
       " ".join(f"{p}_{n}" for p in ("a_b", "a_c", "b_c") for n in ("one", "zero", "between")))
def pair_encoding(t):
    u = F.when(F.col("l_discount") > 0.07, 1.0).when(F.col("l_discount") < 0.03, 0.0).otherwise(0.5)
    g = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_orderkey") % 5).alias("fold"), F.col("l_returnflag").alias("a"),
                          F.col("l_linestatus").alias("b"), (F.col("l_quantity").cast("int") % 4).alias("c"), u.alias("u"))
    return E.pair_target_encode(g, ["a", "b", "c"], "fold", "u").drop("fold", "a", "b", "c", "u")


@query("binned_encoding", "E4 P15", f"""
WITH {CODED}, b AS (SELECT *, CAST(round_even(least(greatest(price, 100), 400) / 5, 0) * 5 AS BIGINT) AS bin FROM c)
SELECT o_orderkey, bin, avg(y) OVER (PARTITION BY fold, bin) AS within, avg(y) OVER (PARTITION BY bin) AS overall FROM b""", "within overall")
def binned_encoding(t):
    from ..functions.scalars import clip, round_to

    b = coded(t).withColumn("bin", round_to(clip("price", 100.0, 400.0), 5))
    d = E.target_encode(b, "bin", "y", "fold", mode="within", name="within")
    return E.target_apply(d, E.target_fit(b, "bin", "y", 0.0), "bin", "overall_te").select("o_orderkey", "bin", "within", F.col("overall_te").alias("overall"))


@query("gaussian_encoding", "E5", f"""
WITH {CODED}, m AS (SELECT avg(price) AS m FROM c),
s AS (SELECT o_orderpriority, count(price) / var_samp(price) AS o, avg(price) AS mu FROM c GROUP BY 1),
a AS (SELECT c.*, coalesce((0.001 * m + o * mu) / (0.001 + o), m) AS first FROM c JOIN s USING (o_orderpriority), m),
s2 AS (SELECT o_custkey, cat, count(price) / nullif(var_samp(price), 0) AS o, avg(price) AS mu, avg(first) AS mp FROM a GROUP BY 1, 2)
SELECT o_orderkey, first, coalesce((0.01 * mp + o * mu) / (0.01 + o), first) AS second, coalesce(1 / (0.01 + o), first) AS variance FROM a JOIN s2 USING (o_custkey, cat)""",
       "first second variance")
def gaussian_encoding(t):
    d = E.gaussian_encode(coded(t), "o_orderpriority", "price", precision=0.001, name="first")
    e = E.gaussian_encode(d, ["o_custkey", "cat"], "price", ["first"], 0.01, name="second")
    return E.gaussian_encode(e, ["o_custkey", "cat"], "price", ["first"], 0.01, "var", "variance").select("o_orderkey", "first", "second", "variance")


@query("last_value_forecast", "E6", """
WITH l AS (SELECT o_custkey, arg_max(o_totalprice / 1000, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1),
o AS (SELECT c_custkey, c_acctbal AS v FROM customer WHERE c_custkey % 10 = 0)
SELECT o_custkey, coalesce(o.v, l.v * 1.01::DOUBLE) AS last_value FROM l LEFT JOIN o ON o_custkey = c_custkey""", "last_value", digits=9)
def last_value_forecast(t):
    l = E.last_value(t.orders.withColumn("price", F.col("o_totalprice") / 1000), "o_custkey", ["o_orderdate", "o_orderkey"], "price", F.lit("1999-01-01").cast("timestamp_ntz"))
    o = t.customer.filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("last_value"))
    return E.apply_override(l, o, "o_custkey", "last_value", 1.01)


# folds and splits


@query("stratified_folds", "V1 V4", """
SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY (o_orderkey * 7919) % 1000003, o_orderkey) - 1) % 5 AS fold,
 (row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY (o_orderkey * 7919) % 1000003, o_orderkey) - 1) % 5 AS joint_fold FROM orders""")
def stratified_folds(t):
    h = (F.col("o_orderkey") * 7919) % 1000003
    d = V.stratified_fold(t.orders, "o_orderstatus", "o_orderkey", 5, draw=h)
    return V.stratified_fold(d, ["o_orderstatus", "o_orderpriority"], "o_orderkey", 5, draw=h, name="joint_fold").select("o_orderkey", "fold", "joint_fold")


@query("multilabel_folds", "V4", """
WITH c AS (SELECT *, count(*) OVER (PARTITION BY quality) AS a, count(*) OVER (PARTITION BY toxic) AS b FROM labels),
r AS (SELECT doc_id, CASE WHEN a <= b THEN 0 ELSE 1 END AS j, CASE WHEN a <= b THEN quality ELSE toxic END AS v FROM c)
SELECT doc_id, (row_number() OVER (PARTITION BY j, v ORDER BY (doc_id * 7919) % 1000003, doc_id) - 1 + j) % 5 AS fold FROM r""")
def multilabel_folds(t):
    return V.multilabel_fold(t.labels, ["quality", "toxic"], "doc_id", 5, draw=(F.col("doc_id") * 7919) % 1000003).select("doc_id", "fold")


@query("group_folds", "V2", """
WITH RECURSIVE g AS (SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS i FROM orders GROUP BY 1),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS o_custkey, CAST(-1 AS BIGINT) AS fold, [0, 0, 0, 0]::BIGINT[] AS loads UNION ALL
  SELECT g.i, g.o_custkey, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + n ELSE x END) FROM r JOIN g ON g.i = r.i + 1)
SELECT o_custkey, fold FROM r WHERE i > 0""", ints="fold")
def group_folds(t):
    return V.group_fold(t.orders, "o_custkey", 4).select("o_custkey", "fold").distinct()


@query("stratified_group_folds", "V3", """
WITH RECURSIVE c AS (SELECT o_custkey, count(*) AS n, sum(CAST(o_orderstatus = 'F' AS INT)) AS y FROM orders GROUP BY 1),
g AS (SELECT *, st.s AS st, row_number() OVER (PARTITION BY st.s ORDER BY n DESC, o_custkey) AS i FROM (SELECT *, CASE WHEN y * 2 > n THEN 1 ELSE 0 END AS s FROM c) AS st),
r AS (SELECT st, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS o_custkey, CAST(0 AS BIGINT) AS n, CAST(0 AS HUGEINT) AS y, CAST(-1 AS BIGINT) AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads FROM (SELECT DISTINCT st FROM g) UNION ALL
  SELECT g.st, g.i, g.o_custkey, g.n, g.y, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + g.n ELSE x END) FROM r JOIN g ON g.st = r.st AND g.i = r.i + 1)
SELECT fold, sum(n)::BIGINT AS n, count(*) AS customers, sum(y)::BIGINT AS positives FROM r WHERE i > 0 GROUP BY fold""", ints="fold")
def stratified_group_folds(t):
    o = t.orders.withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    d = V.stratified_group_fold(o, "y", "o_custkey", 5)
    return d.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.sum("y").alias("positives"))


@query("sliding_splits", "V5", """
WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS last FROM orders), b AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), last) AS back FROM orders, m)
SELECT fold, part, count(*) AS n, min(o_orderkey) AS lo, sum(o_orderkey)::BIGINT AS total FROM b, (SELECT i AS fold, p AS part, CASE p WHEN 'test' THEN i * 7 ELSE (i + 1) * 7 END AS e FROM generate_series(0, 5) s(i), (VALUES ('test'), ('train')) v(p))
WHERE back >= e AND back < e + 42 GROUP BY 1, 2""", ints="fold")
def sliding_splits(t):
    d = V.sliding_split(t.orders, "o_orderdate", 6, 7, 35)
    return d.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lo"), F.sum("o_orderkey").alias("total"))


@query("stepped_splits", "V6", """
WITH m AS (SELECT min(epoch(ts)::BIGINT) AS lo, max(floor(epoch(ts)))::BIGINT AS hi FROM events), m2 AS (SELECT (SELECT min(floor(epoch(ts)))::BIGINT FROM events) AS lo, hi FROM m),
s AS (SELECT event_id, floor(epoch(ts))::BIGINT - lo AS sec, (hi - lo - 864000) / 3.0::DOUBLE AS step FROM events, m2)
SELECT i AS fold, p AS part, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM s, generate_series(0, 3) g(i), (VALUES ('train', 0, 691200), ('test', 691200, 864000)) v(p, a, b)
WHERE sec >= step * i + a AND sec < step * i + b GROUP BY 1, 2""", ints="fold")
def stepped_splits(t):
    d = V.stepped_split(t.events, "ts", 4, 8, 2)
    return d.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@query("range_holdout_splits", "V7 V8", """
SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'valid' ELSE 'test' END AS part,
 CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) < 28 THEN 'valid' ELSE 'train' END AS tail
FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2002-01-01'""")
def range_holdout_splits(t):
    o = V.holdout_last(t.orders, "o_orderdate", 28, "tail")
    r = {"train": ("1996-01-01", "1998-01-01"), "valid": ("1998-01-01", "2000-01-01"), "test": ("2000-01-01", "2002-01-01")}
    return V.range_split(o, "o_orderdate", r).select("o_orderkey", "part", "tail")


@query("label_windows", "V9 J7", """
WITH d AS (SELECT o_orderkey, o_custkey, CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1999-06-30' THEN 'feature' WHEN CAST(o_orderdate AS DATE) <= DATE '1999-07-30' THEN 'label' END AS part FROM orders)
SELECT o_orderkey, part FROM d WHERE part IS NOT NULL AND o_custkey IN (SELECT o_custkey FROM d WHERE part = 'label')""")
def label_windows(t):
    return V.label_window(t.orders, "o_orderdate", "1999-06-30", 30, "o_custkey").select("o_orderkey", "part")


@query("virtual_time_folds", "V10", f"""
WITH {EV}, l AS (SELECT user_id, max(us) AS own FROM ev GROUP BY 1), a AS (SELECT max(us) AS hi FROM ev),
v AS (SELECT event_id, ev.user_id, us + CAST(floor((hi - own) * (((ev.user_id * 37) % 100) / 100.0::DOUBLE)) AS BIGINT) AS vt FROM ev JOIN l ON ev.user_id = l.user_id, a),
p AS (SELECT *, count(*) OVER () - row_number() OVER (ORDER BY vt, event_id) AS back FROM v)
SELECT event_id, vt AS virtual_ts, CASE WHEN back < 500 THEN 'eval' WHEN (back - 500) // 800 < 3 THEN 'valid_' || ((back - 500) // 800) ELSE 'train' END AS part FROM p""")
def virtual_time_folds(t):
    draw = ((F.col("user_id") * 37) % 100) / 100.0
    d = V.virtual_time(log(t), "user_id", "us", draw=draw)
    return V.tail_folds(d, ["virtual_ts", "event_id"], 500, 800, 3).select("event_id", "virtual_ts", "part")


# metrics


def scored(t: Tables):
    """Document labels with a score from the length."""
    d = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    s = (F.col("n_chars") % 1000) / 1000
    return d.select("doc_id", "quality", "toxic", s.alias("p"), (F.col("doc_id") % 3).alias("level"))


SCORED = "sc AS (SELECT doc_id, quality, toxic, (n_chars % 1000) / 1000 AS p, doc_id % 3 AS level FROM labels JOIN documents USING (doc_id))"


@query("auc_quality", "M6", f"""
WITH {SCORED} SELECT sum(CASE WHEN b.p < a.p THEN 1.0::DOUBLE WHEN b.p = a.p THEN 0.5 ELSE 0 END) / count(*) AS auc
FROM sc a JOIN sc b ON a.quality = 1 AND b.quality = 0""", "auc")
def auc_quality(t):
    return M.auc(scored(t), "quality", "p")


@query("gini_capture_quality", "M5", f"""
WITH {SCORED}, w AS (SELECT *, CASE WHEN quality = 0 THEN 20.0::DOUBLE ELSE 1.0 END AS w FROM sc),
a AS (SELECT *, sum(w) OVER x AS cw, sum(quality * w) OVER x AS cp, sum(w) OVER () AS tw, sum(quality) OVER () AS np FROM w WINDOW x AS (ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, sum(w) OVER x AS cw, sum(quality * w) OVER x AS cp, sum(w) OVER () AS tw, sum(quality) OVER () AS np FROM w WINDOW x AS (ORDER BY quality DESC, doc_id ROWS UNBOUNDED PRECEDING))
SELECT 0.5 * ((SELECT sum((cp / np - cw / tw) * w) FROM a) / (SELECT sum((cp / np - cw / tw) * w) FROM b) + (SELECT sum(quality) FILTER (cw <= floor(0.04::DOUBLE * tw)) / max(np) FROM a)) AS score""", "score")
def gini_capture_quality(t):
    return M.gini_capture(scored(t), "quality", "p", "doc_id")


@query("f1_thresholds", "M9", f"""
WITH {SCORED}, t AS (SELECT i / 99.0::DOUBLE AS threshold FROM generate_series(0, 99) g(i)),
c AS (SELECT level, threshold, sum(CAST(p >= threshold AND quality = 1 AS INT))::DOUBLE AS tp, sum(CAST(p >= threshold AND quality = 0 AS INT)) AS fp, sum(CAST(p < threshold AND quality = 1 AS INT)) AS fn, sum(CAST(p < threshold AND quality = 0 AS INT))::DOUBLE AS tn FROM sc, t GROUP BY 1, 2),
f AS (SELECT level, threshold, (CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END + CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2 * tn / (2 * tn + fp + fn) END) / 2 AS f1 FROM c)
SELECT level, f1, threshold FROM f QUALIFY row_number() OVER (PARTITION BY level ORDER BY round(f1, 12) DESC, threshold) = 1""", "f1 threshold")
def f1_thresholds(t):
    return M.best_f1(scored(t), "quality", "p", "level")


@query("error_metrics", "M1 M2 M3 M12", f"""
WITH {SCORED}, r AS (SELECT o_totalprice / 1000 AS y, (o_orderkey % 500)::DOUBLE AS p, 1.0 + o_custkey % 3 AS w FROM orders)
SELECT (SELECT sqrt(avg(pow(y - p, 2))) FROM r) AS rmse, (SELECT (sqrt(avg(pow(y - p, 2))) + sqrt(avg(pow(w - p, 2)))) / 2 FROM r) AS mcrmse,
 (SELECT sqrt(sum(w::DOUBLE * pow(ln(1 + y) - ln(1 + p), 2)) / sum(w::DOUBLE)) FROM r) AS rmsle,
 (SELECT avg(CASE WHEN y = 0 AND p = 0 THEN 0 ELSE abs(y - p) / ((abs(y) + abs(p)) / 2) END * 100) FROM r) AS smape, (SELECT avg(pow(y - p, 2)) FROM r) AS mse,
 (SELECT -avg(quality * ln(greatest(p, 1e-15)) + (1 - quality) * ln(1 - greatest(p, 1e-15))) FROM sc) AS log_loss""", "rmse mcrmse rmsle smape mse log_loss", digits=5)
def error_metrics(t):
    r = t.orders.select((F.col("o_totalprice") / 1000).alias("y"), (F.col("o_orderkey") % 500).cast("double").alias("p"), (1.0 + F.col("o_custkey") % 3).alias("w"))
    parts = [M.rmse(r, "y", "p"), M.mcrmse(r, [("y", "p"), ("w", "p")]), M.rmsle(r, "y", "p", "w"), M.smape(r, "y", "p"), M.mse(r, "y", "p"), M.log_loss(scored(t), "quality", "p")]
    out = parts[0]
    for p in parts[1:]:
        out = out.transform(O.attach, p)
    return out


@query("rmse_by_status", "M1", """
SELECT o_orderstatus, sqrt(avg(pow(o_totalprice / 1000 - o_orderkey % 500, 2))) AS rmse FROM orders GROUP BY 1""", "rmse")
def rmse_by_status(t):
    r = t.orders.select("o_orderstatus", (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_orderkey") % 500).alias("p"))
    return M.rmse(r, "y", "p", "o_orderstatus")


@query("map_at_12", "M7", """
WITH bk AS (SELECT o_custkey, l_partkey, year(l_shipdate) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT o_custkey, list(l_partkey ORDER BY n DESC, l_partkey)[1:12] AS pred FROM (SELECT o_custkey, l_partkey, count(*) AS n FROM bk WHERE y < 2000 GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT o_custkey, list(DISTINCT l_partkey % 50) AS target FROM bk WHERE y >= 2000 GROUP BY 1),
x AS (SELECT o_custkey, list_transform(pred, lambda v: v % 50) AS pred, target FROM p JOIN g USING (o_custkey)),
h AS (SELECT o_custkey, target, unnest(pred) AS v, generate_subscripts(pred, 1) AS i, pred FROM x),
k AS (SELECT o_custkey, i, len(target) AS nt, list_contains(target, v) AND list_position(pred, v) = i AS hit FROM h),
s AS (SELECT o_custkey, nt, CASE WHEN hit THEN sum(CAST(hit AS INT)) OVER (PARTITION BY o_custkey ORDER BY i ROWS UNBOUNDED PRECEDING) / i ELSE 0 END AS c FROM k),
a AS (SELECT o_custkey, sum(c) / min(least(nt, 12)) AS ap FROM s GROUP BY 1) SELECT avg(ap) AS map FROM a""", "map")
def map_at_12(t):
    from .baskets import baskets

    b = baskets(t).withColumn("y", F.year("l_shipdate"))
    n = b.filter("y < 2000").groupBy("o_custkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    pred = K.topk_list(n, "o_custkey", "n", "l_partkey", 12, "pred").withColumn("pred", F.transform("pred", lambda v: v % 50))
    target = b.filter("y >= 2000").groupBy("o_custkey").agg(F.collect_set(F.col("l_partkey") % 50).alias("target"))
    return M.map_at_k(pred.join(target, "o_custkey"), "pred", "target")


def _monthly(t):
    """Sales per level columns and month, stored once for the three tables made from it, and the last month."""
    step = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint")
    last = t.lineitem.agg(F.max(step).alias("last"))
    fine = sales(t).groupBy(*DIMS, step.alias("step")).agg(
        F.sum("l_quantity").alias("l_quantity"), F.sum(F.round(F.col("l_quantity") * 0.9, 0)).alias("p"), F.sum(F.col("l_extendedprice") / 1000).alias("value"))
    return stored(fine).transform(O.attach, last)


_KEY = ", ".join(["level", *DIMS])


@query("wrmsse_levels", "M10", f"""
WITH {SALES}, s AS (SELECT *, year(l_shipdate) * 12 + month(l_shipdate) AS step, round(l_quantity * 0.9, 0) AS p, (SELECT max(year(l_shipdate) * 12 + month(l_shipdate)) FROM lineitem) AS last FROM sales),
tr AS (SELECT * FROM s WHERE step <= last - 3), va AS (SELECT * FROM s WHERE step > last - 3),
past AS ({level_union('tr', 'sum(l_quantity) AS y', ['step'])}), ahead AS ({level_union('va', 'sum(l_quantity) AS y, sum(p) AS p', ['step'])}),
w AS ({level_union('tr', 'sum(l_extendedprice / 1000) AS v')}),
d AS (SELECT *, y - lag(y) OVER (PARTITION BY {_KEY} ORDER BY step) AS d FROM past), sc AS (SELECT {_KEY}, avg(d * d) AS scale FROM d GROUP BY ALL),
er AS (SELECT {_KEY}, avg(pow(y - p, 2)) AS mse FROM ahead GROUP BY ALL), ws AS (SELECT {_KEY}, v / sum(v) OVER (PARTITION BY level) / 12 AS weight FROM w)
SELECT er.level, sum(sqrt(mse / CASE WHEN coalesce(scale, 0) <> 0 THEN scale ELSE 1 END) * weight) AS score, count(*) AS series FROM er
 JOIN ws ON er.level = ws.level AND {' AND '.join(f'er.{c} IS NOT DISTINCT FROM ws.{c}' for c in DIMS)}
 LEFT JOIN sc ON er.level = sc.level AND {' AND '.join(f'er.{c} IS NOT DISTINCT FROM sc.{c}' for c in DIMS)} GROUP BY 1""", "score")
def wrmsse_levels(t):
    s = _monthly(t)
    train, valid = s.filter("step <= last - 3"), s.filter("step > last - 3")
    d = M.wrmsse_table(train, valid, LEVELS, "step", "l_quantity", "p", train)
    return d.groupBy("level").agg(F.sum(F.col("rmsse") * F.col("weight")).alias("score"), F.count(F.lit(1)).alias("series"))


@query("position_error_events", "M11", """
SELECT avg(abs(value - 50) + abs(value / 2 - 20) + 15 * abs(event_id % 5 - user_id % 5)) AS position_error FROM events""", "position_error")
def position_error_events(t):
    e = t.events.select("value", (F.col("value") / 2).alias("y"), (F.col("event_id") % 5).alias("f"), F.lit(50.0).alias("px"), F.lit(20.0).alias("py"), (F.col("user_id") % 5).alias("pf"))
    return M.position_error(e, "value", "y", "f", "px", "py", "pf")


@query("batch_validation", "M13", """
SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 0) AS predicted, (SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0) AS expected,
 (SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0) AS missing, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0) AS unexpected, 0 AS repeated""", ints="repeated")
def batch_validation(t):
    return M.validate_batch(t.orders.filter("o_orderkey % 7 <> 0"), t.orders.filter("o_orderkey % 5 <> 0"), "o_orderkey")
