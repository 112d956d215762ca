"""Queries on joins: lookups, time bands, neighbours, intervals, dense ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J, metrics as M, reshape as R
from .catalog import Tables, query
from .panel import EV, log

MIN = 60_000_000


def clicks(t: Tables):
    """Clicks with the time in milliseconds."""
    return log(t).filter("event_type = 'click'").select("user_id", F.col("event_id").alias("cid"), F.floor(F.col("us") / 1000).alias("ct"))


def views(t: Tables):
    return log(t).filter("event_type = 'view'").select("user_id", F.col("event_id").alias("vid"), F.floor(F.col("us") / 1000).alias("vt"), "value")


CV = f"""{EV}, c AS (SELECT user_id, event_id AS cid, us // 1000 AS ct FROM ev WHERE event_type = 'click'),
v AS (SELECT user_id, event_id AS vid, us // 1000 AS vt, value FROM ev WHERE event_type = 'view')"""


@query("join_kinds", "J1 J2 J3 J4 J6 J15", """
WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT 'inner' AS kind, k, n, top FROM a JOIN b USING (k) UNION ALL SELECT 'left', k, n, top FROM a LEFT JOIN b USING (k)
UNION ALL SELECT 'right', k, n, top FROM a RIGHT JOIN b USING (k) UNION ALL SELECT 'outer', k, coalesce(n, 0), coalesce(top, 0) FROM a FULL JOIN b USING (k)""")
def join_kinds(t):
    a = t.orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("top"))
    parts = {"inner": J.join_blocks([a, b], "k"), "left": J.lookup(a, b, "k"), "right": J.join_blocks([a, b], "k", "right"), "outer": J.join_blocks([a, b], "k", "outer").fillna(0)}
    return R.union_labeled(parts, "kind")


@query("customer_nation_sql", "J5 P2", """
SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def customer_nation_sql(t):
    views = {"c": t.customer, "n": t.nation, "r": t.region}
    return t.spark.sql(
        "SELECT * EXCEPT (c_name, c_nationkey, c_acctbal, n_nationkey, n_regionkey, r_regionkey) FROM {c} "
        "LEFT JOIN {n} ON c_nationkey = n_nationkey LEFT JOIN {r} ON n_regionkey = r_regionkey", **views)


@query("buyers_and_others", "J7 J8", """
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS buyer FROM customer""")
def buyers_and_others(t):
    big = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    c = t.customer.select("c_custkey")
    return J.semi(c, big, "c_custkey").withColumn("buyer", F.lit(True)).unionByName(J.anti(c, big, "c_custkey").withColumn("buyer", F.lit(False)))


@query("band_topk", "J9", f"""
WITH {CV}, j AS (SELECT c.user_id, cid, vid, vt, value, row_number() OVER (PARTITION BY cid, value, vt ORDER BY value DESC, vid) AS u FROM c JOIN v ON c.user_id = v.user_id AND abs(ct - vt) <= 14400000),
r AS (SELECT user_id, cid, vid, vt, value, row_number() OVER (PARTITION BY cid ORDER BY value DESC, vid) AS rank FROM j WHERE u = 1)
SELECT * FROM r WHERE rank <= 3""")
def band_topk(t):
    return J.band_topk_join(clicks(t), views(t), "user_id", "cid", "ct", "vt", "vid", 14_400_000, "value", 3, unique=["value", "vt"])


@query("band_topk_crowded", "J9", f"""
WITH {CV}, j AS (SELECT c.user_id, cid, vid, vt, value, row_number() OVER (PARTITION BY cid, value ORDER BY value DESC, vid) AS u FROM c JOIN v ON c.user_id = v.user_id AND abs(ct - vt) <= 200000000),
r AS (SELECT user_id, cid, vid, vt, value, row_number() OVER (PARTITION BY cid ORDER BY value DESC, vid) AS rank FROM j WHERE u = 1)
SELECT * FROM r WHERE rank <= 4""")
def band_topk_crowded(t):
    return J.band_topk_join(clicks(t), views(t), "user_id", "cid", "ct", "vt", "vid", 200_000_000, "value", 4, unique=["value"], dense=4)


@query("neighbor_views", "J10", f"""
WITH {CV}, b AS (SELECT cid, list(value ORDER BY vt DESC, vid DESC)[1:3] AS value_before FROM c JOIN v ON c.user_id = v.user_id AND vt < ct GROUP BY 1),
a AS (SELECT cid, list(value ORDER BY vt, vid)[1:3] AS value_after FROM c JOIN v ON c.user_id = v.user_id AND vt > ct GROUP BY 1)
SELECT user_id, cid, coalesce(value_before, []) AS value_before, coalesce(value_after, []) AS value_after FROM c LEFT JOIN b USING (cid) LEFT JOIN a USING (cid)""")
def neighbor_views(t):
    c, v = clicks(t), views(t)
    back = J.neighbors_join(c, v, "user_id", "cid", "ct", "vt", "vid", "value", 3)
    return back.join(J.neighbors_join(c, v, "user_id", "cid", "ct", "vt", "vid", "value", 3, "after"), ["user_id", "cid"])


@query("between_clicks", "J11", f"""
WITH {CV}, n AS (SELECT *, lag(ct) OVER w AS prev, lead(ct) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ct, cid))
SELECT n.user_id, cid, vid, value FROM n JOIN v ON n.user_id = v.user_id AND (prev IS NULL OR vt > prev) AND (nxt IS NULL OR vt < nxt)""")
def between_clicks(t):
    return J.between_neighbors_join(clicks(t), views(t), "user_id", "cid", "ct", "vt", "vid", "value")


@query("views_in_intervals", "J12", f"""
WITH {EV}, m AS (SELECT user_id, event_type, us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS i FROM ev WHERE event_type IN ('click', 'purchase')),
iv AS (SELECT user_id, i, max(us) FILTER (event_type = 'click') AS s, max(us) FILTER (event_type = 'purchase') AS e FROM m GROUP BY 1, 2)
SELECT user_id, event_id FROM ev WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM iv WHERE iv.user_id = ev.user_id AND ev.us BETWEEN s AND e)""")
def views_in_intervals(t):
    e = log(t)
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "end")
    iv = R.to_intervals(e.withColumn("kind", kind), "user_id", ["us", "event_id"], "kind", "us")
    return J.in_intervals(e.filter("event_type = 'view'"), iv, "user_id", "us", "event_id").select("user_id", "event_id")


@query("class_grid", "J13", """
SELECT user_id, event, tolerance FROM (SELECT DISTINCT user_id FROM events), (VALUES ('click', 0.5::DOUBLE), ('click', 1.0::DOUBLE), ('view', 2.0::DOUBLE)) g(event, tolerance)""")
def class_grid(t):
    return J.cross_keys(t.events, "user_id", {"click": [0.5, 1.0], "view": [2.0]})


@query("type_hour_range", "J16", f"""
WITH {EV}, h AS (SELECT event_type, us // 3600000000 AS hour, sum(value) AS total FROM ev WHERE value > 40 GROUP BY 1, 2),
s AS (SELECT event_type, unnest(generate_series(min(hour), max(hour))) AS hour FROM h GROUP BY 1), j AS (SELECT event_type, hour, total FROM s LEFT JOIN h USING (event_type, hour))
SELECT event_type, hour, last_value(total IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY hour ROWS UNBOUNDED PRECEDING) AS total FROM j""", "total")
def type_hour_range(t):
    h = log(t).filter("value > 40").groupBy("event_type", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(F.sum("value").alias("total"))
    return J.complete_range(h, "event_type", "hour", pad=["total"])


@query("tax_snapped", "J17", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_min(list_transform([0.0::DOUBLE, 0.025, 0.08], lambda v: {'d': abs(l_tax - v), 'v': v})).v AS snapped FROM lineitem""", "snapped")
def tax_snapped(t):
    return J.snap_nearest(t.lineitem, "l_tax", [0.0, 0.025, 0.08], "snapped").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "snapped")


_TOLERANCES = {"view": [60.0, 600.0], "purchase": [60.0, 600.0, 3600.0]}


def detections(t: Tables):
    """Marks (clicks open and errors close an interval), facts (views, purchases) and shifted copies of the facts as detections."""
    e = log(t).withColumn("time", F.col("us") / 1e6 - 1704067200)
    e = e.withColumn("video_id", F.col("user_id"))
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "error", "end").otherwise(F.col("event_type"))
    truth = e.select("video_id", "time", kind.alias("event"))
    dets = e.filter(F.col("event_type").isin(*_TOLERANCES)).select(
        "video_id", (F.col("time") + (F.col("event_id") * 37 % 1000 - 500)).alias("time"), F.col("event_type").alias("event"),
        ((F.col("event_id") * 7919 % 997) / 997).alias("score"), F.col("event_id").alias("det_id"))
    return truth, dets


@query("event_average_precision", "J14 M8", f"""
WITH RECURSIVE {EV}, e AS (SELECT user_id AS v, event_id AS id, event_type AS event, us / 1e6 - 1704067200 AS t FROM ev),
g(event, tol) AS (VALUES {', '.join(f"('{k}', {x}::DOUBLE)" for k, xs in _TOLERANCES.items() for x in xs)}),
k AS (SELECT v, event, t, row_number() OVER (PARTITION BY v, event ORDER BY t) AS i FROM e WHERE event IN ('click', 'error')),
iv AS (SELECT v, i, max(t) FILTER (event = 'click') AS s, max(t) FILTER (event = 'error') AS e FROM k GROUP BY 1, 2),
f AS (SELECT v, event, list(t ORDER BY t) AS ts FROM e WHERE event NOT IN ('click', 'error') GROUP BY 1, 2),
a AS (SELECT v, event, id, t + (id * 37 % 1000 - 500) AS t, (id * 7919 % 997) / 997.0::DOUBLE AS score FROM e WHERE event IN (SELECT event FROM g)),
b AS (SELECT * FROM a WHERE EXISTS (SELECT 1 FROM iv WHERE iv.v = a.v AND a.t BETWEEN iv.s AND iv.e)),
d AS (SELECT b.*, ts, row_number() OVER (PARTITION BY v, event ORDER BY score DESC, id) AS i FROM b JOIN f USING (v, event)),
r AS (SELECT v, event, tol, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken, false AS hit, CAST(0 AS DOUBLE) AS score FROM (SELECT DISTINCT v, event FROM d) JOIN g USING (event) UNION ALL
  SELECT v, event, tol, i, CASE WHEN j IS NULL THEN taken ELSE list_append(taken, j) END, j IS NOT NULL, score FROM (
    SELECT r.v, r.event, r.tol, d.i, r.taken, d.score, list_sort(list_transform(list_filter(range(1, len(ts) + 1), lambda j: abs(ts[j] - d.t) < r.tol AND NOT list_contains(r.taken, j)), lambda j: {{'g': abs(ts[j] - d.t), 'j': j}}))[1].j AS j
    FROM r JOIN d ON d.v = r.v AND d.event = r.event AND d.i = r.i + 1)),
s AS (SELECT event, tol, score, sum(CAST(hit AS INT)) AS tp, count(*) AS n FROM r WHERE i > 0 GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM s WINDOW w AS (PARTITION BY event, tol ORDER BY score DESC)),
p AS (SELECT event, count(*) AS p FROM e GROUP BY 1)
SELECT event, tol AS tolerance, sum(tp * ctp / cn::DOUBLE) / max(p) AS ap FROM c JOIN p USING (event) GROUP BY 1, 2""", "ap")
def event_average_precision(t):
    truth, dets = detections(t)
    return M.event_ap_table(truth, dets, _TOLERANCES)
