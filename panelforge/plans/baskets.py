"""Queries on baskets (customer x part), ranked lists, layouts and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A, ordered as O, ranking as K, reshape as R, sequences as Q
from .catalog import Tables, query
from .panel import EV, MO, SM, U, UO, W_EV, W_SM, log, supplier_month


def baskets(t: Tables):
    """Line items with their customer."""
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("o_custkey", "l_partkey", "l_quantity", "l_orderkey", "l_linenumber", "l_shipdate")


BK = "bk AS (SELECT o_custkey, l_partkey, l_quantity, l_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("top_parts", "T2 T1", """
SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, l_partkey LIMIT 12""")
def top_parts(t):
    return K.top_values(t.lineitem, "l_partkey", 12)


@query("customer_part_topk", "T3", f"""
WITH {BK}, c AS (SELECT o_custkey, l_partkey, count(*) AS count FROM bk GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY count DESC, l_partkey) AS rank FROM c) WHERE rank <= 3""")
def customer_part_topk(t):
    return K.top_values_by(baskets(t), "o_custkey", "l_partkey", 3)


@query("customer_lists", "T4 T5 T6 J4", f"""
WITH {BK}, s AS (SELECT o_custkey, l_partkey, sum(l_quantity) AS q, count(*) AS c FROM bk GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY q DESC, l_partkey) AS rq, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, l_partkey) AS rc FROM s),
l AS (SELECT o_custkey, list(l_partkey ORDER BY rq) FILTER (rq <= 4) AS by_quantity, list(l_partkey ORDER BY rc) FILTER (rc <= 4) AS by_count FROM r GROUP BY 1),
v AS (SELECT o_custkey, x, sum(w) AS w, min(pos) AS pos FROM (
  SELECT o_custkey, unnest(by_quantity) AS x, 0.75 AS w, generate_subscripts(by_quantity, 1) AS pos FROM l UNION ALL
  SELECT o_custkey, unnest(by_count), 0.25, 10 + generate_subscripts(by_count, 1) FROM l) GROUP BY 1, 2),
o AS (SELECT o_custkey, list(x ORDER BY w DESC, pos) AS voted FROM v GROUP BY 1),
p AS (SELECT list(l_partkey ORDER BY n DESC, l_partkey) AS top FROM (SELECT l_partkey, count(*) AS n FROM bk GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 6))
SELECT l.o_custkey, by_quantity, by_count, voted[1:5] AS voted, (voted || list_filter(top, lambda t: NOT list_contains(voted, t)))[1:8] AS filled FROM l JOIN o ON l.o_custkey = o.o_custkey, p""")
def customer_lists(t):
    b = baskets(t)
    s = b.groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("c"))
    lists = K.topk_list(s, "o_custkey", "q", "l_partkey", 4, "by_quantity").join(K.topk_list(s, "o_custkey", "c", "l_partkey", 4, "by_count"), "o_custkey")
    top = K.topk_list(K.top_values(b, "l_partkey", 6).withColumn("one", F.lit(1)), "one", "count", "l_partkey", 6, "top").drop("one")
    all_votes = K.vote_lists(["by_quantity", "by_count"], [3, 1], 100)
    out = lists.transform(O.attach, top).withColumn("v", all_votes)
    return out.select("o_custkey", "by_quantity", "by_count", F.slice("v", 1, 5).alias("voted"), K.fallback_list(F.col("v"), F.col("top"), 8).alias("filled"))


@query("user_key_sample", "T7 S5", """
SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM events WHERE (user_id * 7919 + 13) % 1000 < 300 GROUP BY 1""")
def user_key_sample(t):
    draw = ((F.col("user_id") * 7919 + 13) % 1000) / 1000
    return K.sample_by_key(t.events, "user_id", 0.0, 0.3, draw=draw).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("negative_parts", "T8 R3 J8", f"""
WITH {BK}, own AS (SELECT DISTINCT o_custkey, l_partkey FROM bk), n AS (SELECT count(DISTINCT l_partkey) AS size FROM bk),
items AS (SELECT l_partkey, row_number() OVER (ORDER BY count(*) DESC, l_partkey) - 1 AS slot FROM bk GROUP BY 1),
u AS (SELECT o_custkey, count(*) AS own, (o_custkey * 31 + 7) % 2147483647 AS start FROM own GROUP BY 1),
w AS (SELECT o_custkey, unnest(generate_series(1, least(size, 5 + own))) AS try, start, size FROM u, n),
f AS (SELECT w.o_custkey, l_partkey, try FROM w JOIN items ON slot = (start + try * 2147483647) % size WHERE (w.o_custkey, l_partkey) NOT IN (SELECT (o_custkey, l_partkey) FROM own)),
a AS (SELECT o_custkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY try) AS r FROM f) WHERE r <= 5),
w2 AS (SELECT o_custkey, unnest(generate_series(1, least(50, 2 + own))) AS try, start FROM u),
f2 AS (SELECT w2.o_custkey, l_partkey, try FROM w2 JOIN items ON slot = (start + try * 2147483647) % 50 AND slot < 50 WHERE (w2.o_custkey, l_partkey) NOT IN (SELECT (o_custkey, l_partkey) FROM own)),
b AS (SELECT o_custkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY try) AS r FROM f2) WHERE r <= 2)
SELECT * FROM a UNION SELECT * FROM b""")
def negative_parts(t):
    draw = F.col("o_custkey") * 31 + 7
    return K.negative_samples(baskets(t), "o_custkey", "l_partkey", 5, popular=50, n_popular=2, draw=draw)


@query("order_batches", "T9 T10", """
SELECT o_orderkey, (row_number() OVER (ORDER BY (o_orderkey * 7919) % 1000003, o_orderkey) - 1) // 100 AS batch FROM orders""")
def order_batches(t):
    o = t.orders.withColumn("h", (F.col("o_orderkey") * 7919) % 1000003)
    return K.batches(o, ["h", "o_orderkey"], 100).select("o_orderkey", "batch")


@query("order_sample", "T10", """
SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 7919) % 1000003, o_orderkey LIMIT 250""")
def order_sample(t):
    return K.sample(t.orders, "o_orderkey", 250, draw=(F.col("o_orderkey") * 7919) % 1000003).select("o_orderkey")


# layouts


@query("key_sets", "R2 R3", """
SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, CAST(a.l_partkey IS NOT NULL AS INT) AS in_left, CAST(b.l_partkey IS NOT NULL AS INT) AS in_right
FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A') a FULL JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.08) b USING (l_partkey)""",
       ints="in_left in_right")
def key_sets(t):
    l = t.lineitem
    return R.key_sets(l.filter("l_returnflag = 'A'"), l.filter("l_discount > 0.08"), "l_partkey")


def _wide(t: Tables):
    """Quantity per supplier with a column per month 1..12."""
    m = F.month("l_shipdate")
    return t.lineitem.groupBy("l_suppkey").agg(*[F.sum(F.when(m == i, F.col("l_quantity"))).alias(f"d_{i}") for i in range(1, 13)])


@query("supplier_melt_horizon", "R4 R5 P2", """
WITH l AS (SELECT l_suppkey, month(l_shipdate) AS d, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
k AS (SELECT DISTINCT l_suppkey FROM lineitem), g AS (SELECT l_suppkey, d FROM k, generate_series(1, 14) AS s(d))
SELECT l_suppkey, CAST(d AS BIGINT) AS d, value FROM g LEFT JOIN l USING (l_suppkey, d)""")
def supplier_melt_horizon(t):
    return R.extend_horizon(R.melt_days(_wide(t), "l_suppkey"), "l_suppkey", "d", 2)


@query("supplier_pivot_forecast", "R6", """
SELECT l_suppkey, sum(l_quantity) FILTER (month(l_shipdate) = 10) AS "F1", sum(l_quantity) FILTER (month(l_shipdate) = 11) AS "F2", sum(l_quantity) FILTER (month(l_shipdate) = 12) AS "F3"
FROM lineitem WHERE month(l_shipdate) >= 10 GROUP BY 1""")
def supplier_pivot_forecast(t):
    return R.pivot_forecast(R.melt_days(_wide(t), "l_suppkey"), "l_suppkey", "d", "value", 10, 3)


@query("customer_melt_years", "R7", """
SELECT k.o_custkey, CAST(y AS BIGINT) AS year, sum(o_totalprice) FILTER (year(o_orderdate) = y) AS total, count(o_orderkey) FILTER (year(o_orderdate) = y) AS n
FROM orders k, (SELECT DISTINCT year(o_orderdate) AS y FROM orders) v GROUP BY 1, 2""", "total", digits=2)
def customer_melt_years(t):
    y = F.year("o_orderdate")
    years = sorted(r[0] for r in t.orders.select(y).distinct().collect())  # a column each
    wide = t.orders.groupBy("o_custkey").agg(
        *[F.sum(F.when(y == v, F.col("o_totalprice"))).alias(f"total_{v}") for v in years], *[F.count(F.when(y == v, 1)).alias(f"n_{v}") for v in years]
    )
    return R.melt_suffix(wide, "o_custkey", ["total", "n"], years)


@query("customer_pivot_ranked", "R8", """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT o_custkey, max(o_totalprice) FILTER (rank = 1) AS o_totalprice_1, max(o_totalprice) FILTER (rank = 2) AS o_totalprice_2, max(o_totalprice) FILTER (rank = 3) AS o_totalprice_3,
 max(o_orderkey) FILTER (rank = 1) AS o_orderkey_1, max(o_orderkey) FILTER (rank = 2) AS o_orderkey_2, max(o_orderkey) FILTER (rank = 3) AS o_orderkey_3 FROM r WHERE rank <= 3 GROUP BY 1""")
def customer_pivot_ranked(t):
    r = K.top_rows(t.orders, "o_custkey", 3, F.desc("o_totalprice"), F.col("o_orderkey"))
    return R.pivot_ranked(r, "o_custkey", "rank", ["o_totalprice", "o_orderkey"], 3)


@query("user_intervals", "R9", f"""
WITH {EV}, m AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'start' ELSE 'end' END AS kind, us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS interval FROM ev WHERE event_type IN ('click', 'view'))
SELECT user_id, interval, max(us) FILTER (kind = 'start') AS start, max(us) FILTER (kind = 'end') AS "end" FROM m GROUP BY 1, 2""")
def user_intervals(t):
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "view", "end")
    return R.to_intervals(log(t).withColumn("kind", kind), "user_id", UO, "kind", "us")


@query("supplier_name_parts", "R10 R11 F12", """
SELECT s_suppkey, split_part(s_name, '#', 1) AS who, split_part(s_name, '#', 2) AS num, CASE split_part(s_name, '#', 1) WHEN 'Supplier' THEN 1 END AS code,
 concat_ws('_', s_suppkey, s_nationkey) AS pair, split_part(concat_ws('_', s_suppkey, s_nationkey), '_', 2) AS nation, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS padded,
 regexp_extract(s_name, '0*([0-9]+)$', 1) AS short FROM supplier""", ints="code")
def supplier_name_parts(t):
    d = R.parse_delimited(t.supplier, "s_name", ["who", "num"], sep="#")
    d = d.withColumns({"code": S.map_values("who", {"Supplier": 1}), "pair": S.build_key(["s_suppkey", "s_nationkey"])})
    return d.select("s_suppkey", "who", "num", "code", "pair", S.split_key("pair", "_", 1).alias("nation"),
                    F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("padded"), F.regexp_extract("s_name", "0*([0-9]+)$", 1).alias("short"))


_STAGE = ("night", "day", "evening")


@query("user_stage_blocks", "R12 V11", f"""
WITH {EV}, g AS (SELECT user_id, value, CASE WHEN hour(ts) <= 7 THEN 'night' WHEN hour(ts) <= 17 THEN 'day' ELSE 'evening' END AS stage FROM ev),
a AS (SELECT user_id, {', '.join(f"count(*) FILTER (stage = '{s}') AS {s}_n, sum(value) FILTER (stage = '{s}') AS {s}_sum" for s in _STAGE)} FROM g GROUP BY 1),
k AS (SELECT DISTINCT user_id, stage, CASE stage WHEN 'night' THEN 0 WHEN 'day' THEN 1 ELSE 2 END AS r FROM g)
SELECT user_id, stage, {', '.join(f"CASE WHEN r >= {i} THEN nullif({s}_n, 0) END AS {s}_n, CASE WHEN r >= {i} THEN {s}_sum END AS {s}_sum" for i, s in enumerate(_STAGE))} FROM k JOIN a USING (user_id)""",
       " ".join(f"{s}_sum" for s in _STAGE))
def user_stage_blocks(t):
    from ..operators.splitting import stage_label

    e = t.events.withColumn("hour", F.hour("ts")).withColumn("stage", stage_label("hour", {"night": 7, "day": 17, "evening": 24}))
    return R.stack_stages(e, "user_id", "stage", _STAGE, {"n": F.count(F.lit(1)), "sum": F.sum("value")})


_KINDS = ("click", "error", "purchase", "signup", "view")


@query("day_measures", "R13", """
SELECT CAST(ts AS DATE) AS day, """ + ", ".join(f"sum(value) FILTER (event_type = '{v}') AS {v}_total, count(*) FILTER (event_type = '{v}') AS {v}_n" for v in _KINDS) + """
FROM events GROUP BY 1""", " ".join(f"{v}_total" for v in _KINDS))
def day_measures(t):
    per = t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    out = R.pivot_measures(per, "day", "event_type", list(_KINDS), ["total", "n"])
    return out.fillna(0, subset=[c for c in out.columns if c.endswith("_n")])


# sequences


@query("user_sequences", "Q1 Q2 Q3 Q4 Q6", f"""
WITH {EV}, k AS (SELECT user_id FROM ev GROUP BY 1 HAVING count(*) > 40), r AS (SELECT ev.*, row_number() OVER ({W_EV}) AS i FROM ev JOIN k USING (user_id)),
s AS (SELECT user_id, list(event_id ORDER BY i) AS ids FROM r GROUP BY 1),
p AS (SELECT user_id, (i - 1) // 64 AS piece, list(event_id ORDER BY i) AS ids, list(value ORDER BY i) AS vals FROM r GROUP BY 1, 2)
SELECT user_id, piece, p.ids, vals, CASE WHEN len(s.ids) >= 70 THEN s.ids[-70:] ELSE list_resize(CAST([] AS BIGINT[]), 70 - len(s.ids), -1) || s.ids END AS left70,
 CASE WHEN len(s.ids) >= 70 THEN s.ids[1:70] ELSE list_resize(s.ids, 70, -1) END AS right70, [-9] || s.ids[1:least(len(s.ids), 70) - 1] AS shifted,
 list_transform(CASE WHEN len(s.ids) >= 70 THEN s.ids[-70:] ELSE list_resize(CAST([] AS BIGINT[]), 70 - len(s.ids), -1) || s.ids END, lambda x: x = -1) AS mask
FROM p JOIN s USING (user_id)""")
def user_sequences(t):
    e = log(t).select("user_id", "us", F.col("event_id"), F.col("event_id").alias("ids"), F.col("value").alias("vals"))
    long = Q.longer_keys(e, U, 40)
    pieces = Q.sequences(long, U, UO, ["ids", "vals"], 64, split=O.splitters(e, U, UO))
    left = Q.last_n(long, U, UO, "ids", 70).select("user_id", Q.pad_left("ids", 70, -1).alias("left70"))
    first = Q.first_n(long, U, UO, "ids", 70)
    right = first.select("user_id", Q.pad_right("ids", 70, -1).alias("right70"), Q.shift_right("ids", -9).alias("shifted"))
    return pieces.join(left, "user_id").join(right, "user_id").withColumn("mask", Q.pad_mask("left70", -1))


@query("user_chunks", "Q5", f"""
WITH {EV}, r AS (SELECT user_id, event_id, us, (row_number() OVER ({W_EV}) - 1) // 25 AS piece FROM ev)
SELECT user_id, piece, list(event_id ORDER BY us, event_id) AS ids FROM r GROUP BY 1, 2 HAVING count(*) >= 10""")
def user_chunks(t):
    return Q.chunk(log(t).withColumn("ids", F.col("event_id")), U, UO, "ids", 25, 10)


@query("user_last_n", "W25 Q3", f"""
WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS b FROM ev)
SELECT user_id, list(event_type ORDER BY us, event_id) AS kinds FROM r WHERE b <= 12 GROUP BY 1""")
def user_last_n(t):
    return Q.last_n(log(t).withColumnRenamed("event_type", "kinds"), U, UO, "kinds", 12)


@query("customer_item_weights", "Q7", f"""
WITH {BK}, c AS (SELECT o_custkey, l_partkey, count(*) AS n FROM bk GROUP BY 1, 2)
SELECT o_custkey, l_partkey, ln(n + 10) / ln(max(n) OVER (PARTITION BY o_custkey) + 10) AS weights FROM c""", "weights")
def customer_item_weights(t):
    return Q.item_weights(baskets(t), "o_custkey", "l_partkey")


@query("customer_multi_hot", "Q8", f"""
WITH {BK}, c AS (SELECT o_custkey, p_type, count(*) AS n FROM bk JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
w AS (SELECT o_custkey, p_type, ln(n + 10) / ln(max(n) OVER (PARTITION BY o_custkey) + 10) AS w FROM c)
SELECT o_custkey, [coalesce(round(max(w) FILTER (p_type = 'ECONOMY'), 6), 0), coalesce(round(max(w) FILTER (p_type = 'SMALL'), 6), 0), 0.0::DOUBLE] AS hot FROM w GROUP BY 1""")
def customer_multi_hot(t):
    b = baskets(t).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    m = Q.weight_map(Q.item_weights(b, "o_custkey", "p_type"), "o_custkey", "p_type", 1000)
    return m.select("o_custkey", Q.multi_hot_map("weights", ["ECONOMY", "SMALL", "none"]).alias("hot"))


@query("event_props", "Q9 S15", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, [CAST(json_extract(props, '$.k') AS BIGINT), 1] AS pair FROM events""")
def event_props(t):
    k = F.from_json("props", "k bigint")["k"]
    text = F.concat(F.lit("["), k.cast("string"), F.lit(", 1]"))
    return t.events.select("event_id", k.alias("k"), F.transform(Q.parse_int_list(text), lambda x: x.cast("bigint")).alias("pair"))


@query("label_mean_vectors", "Q10", """
WITH r AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS b, least(5, count(*) OVER (PARTITION BY label)) AS n FROM embeddings),
e AS (SELECT label, n + 1 - b AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM r WHERE b <= 5),
m AS (SELECT label, i, sum(x::DOUBLE * w) / sum(w) AS m, avg(x::DOUBLE) AS a FROM e GROUP BY 1, 2)
SELECT label, list(round(m, 6) + 0.0 ORDER BY i) AS weighted, list(round(a, 6) + 0.0 ORDER BY i) AS plain FROM m GROUP BY 1""")
def label_mean_vectors(t):
    a = Q.mean_vector(t.embeddings, "label", "vec_id", "embedding", 5, weighted=True).withColumnRenamed("embedding", "weighted")
    return a.join(Q.mean_vector(t.embeddings, "label", "vec_id", "embedding", 5).withColumnRenamed("embedding", "plain"), "label")


@query("vector_cosine", "Q11", """
WITH c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS similarity FROM embeddings JOIN c USING (label)""", "similarity")
def vector_cosine(t):
    e = t.embeddings
    long = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = long.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda v: v["m"]).alias("c"))
    return e.join(c, "label").select("vec_id", Q.cosine("embedding", "c").alias("similarity"))


@query("customer_group_sizes", "Q13", """
SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1""")
def customer_group_sizes(t):
    return Q.group_sizes(t.orders, "o_custkey")


@query("user_piece_means", "U3", f"""
WITH {EV}, r AS (SELECT user_id, event_id, value, (row_number() OVER ({W_EV}) - 1) // 25 AS piece FROM ev)
SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id, piece) AS off FROM r""", "off")
def user_piece_means(t):
    off = lambda pdf: pdf.assign(off=pdf["value"] - pdf["value"].mean())[["user_id", "event_id", "off"]]
    e = log(t).select("user_id", "us", "event_id", "value")
    return Q.apply_by_piece(e, U, UO, off, "user_id bigint, event_id bigint, off double", 25)
