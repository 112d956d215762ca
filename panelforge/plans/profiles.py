"""Queries on entity profiles, category counts, hierarchies and column cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A, cleaning as C, ordered as O
from .catalog import Tables, query
from .panel import EV, U, UO, log

CO = ["o_orderdate", "o_orderkey"]
W_CO = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
AT = "(o_orderdate, o_orderkey)"


def bound(t: Tables):
    """Orders with the price in thousands."""
    return t.orders.withColumn("price", F.col("o_totalprice") / 1000)


@query("customer_order_profile", "A1 A2 A3 P5", f"""
WITH p AS (SELECT o_custkey, avg(price) AS m, stddev_samp(price) AS s, min(price) AS lo, max(price) AS hi,
  arg_min(price, {AT}) AS f, arg_max(price, {AT}) AS l, count(o_orderpriority) AS priority_count,
  arg_min(o_orderpriority, {AT}) AS priority_first, arg_max(o_orderpriority, {AT}) AS priority_last, count(DISTINCT o_orderpriority) AS priority_nunique
  FROM (SELECT *, o_totalprice / 1000 AS price FROM orders) GROUP BY 1)
SELECT o_custkey, m AS price_mean, s AS price_std, lo AS price_min, hi AS price_max, f AS price_first, l AS price_last,
  l - m AS price_last_mean_sub, l / m AS price_last_mean_div, l - f AS price_last_first_sub, l / f AS price_last_first_div,
  l - hi AS price_last_max_sub, l / hi AS price_last_max_div, priority_count, priority_first, priority_last, priority_nunique FROM p""",
       "price_mean price_std price_min price_max price_first price_last price_last_mean_sub price_last_mean_div price_last_first_sub price_last_first_div price_last_max_sub price_last_max_div", digits=9)
def customer_order_profile(t):
    o = bound(t).withColumnRenamed("o_orderpriority", "priority")
    num = A.profile_deltas(A.numeric_profile(o, "o_custkey", CO, "price"), "price").drop("price_last_rounded")
    return num.join(A.category_profile(o, "o_custkey", CO, "priority"), "o_custkey")


@query("customer_last_rows", "A4 A5", f"""
WITH r AS (SELECT o_custkey, o_totalprice / 1000 AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS b FROM orders)
SELECT o_custkey, max(CASE WHEN b = 1 THEN p END) - max(CASE WHEN b = 2 THEN p END) AS price_last_diff,
  avg(p) FILTER (b > 2) AS price_mean_before_2, avg(p) FILTER (b > 5) AS price_mean_before_5 FROM r GROUP BY 1""",
       "price_last_diff price_mean_before_2 price_mean_before_5", digits=9)
def customer_last_rows(t):
    o = bound(t)
    return A.last_diff(o, "o_custkey", CO, "price").join(A.mean_before_last(o, "o_custkey", CO, "price", [2, 5]), "o_custkey")


@query("priority_conditional_means", "A6 A10 P24", """
SELECT o_orderpriority, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS f_share,
  avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS open_price, count(DISTINCT o_custkey) AS customers, count(*) AS n
FROM orders GROUP BY 1""", "f_share open_price", digits=4)
def priority_conditional_means(t):
    return A.conditional_agg(t.orders, "o_orderpriority", {
        "f_share": F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)),
        "open_price": F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))),
        "customers": F.count_distinct("o_custkey"), "n": F.count(F.lit(1)),
    })


@query("part_quantity_profile", "A7 A8 U4", """
SELECT l_partkey, count(*) / (SELECT count(*) FROM lineitem) AS quantity_share, avg(l_quantity) AS quantity_avg, stddev_samp(l_quantity) AS quantity_std,
  min(l_quantity) AS quantity_min, max(l_quantity) AS quantity_max, median(l_quantity) AS quantity_median FROM lineitem GROUP BY 1""",
       "quantity_share quantity_avg quantity_std quantity_median", digits=8)
def part_quantity_profile(t):
    return A.content_profile(t.lineitem, "l_partkey", "l_quantity", "quantity")


@query("brand_quantity", "A9 J5 J2", """
SELECT p_brand, p_type, count(*) AS n, avg(l_quantity) AS avg_quantity, sum(l_quantity) AS sum_quantity
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""", "avg_quantity")
def brand_quantity(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("avg_quantity"), F.sum("l_quantity").alias("sum_quantity"))


@query("user_keyword_aggs", "A11", f"""
WITH {EV}, w AS (SELECT user_id, {', '.join(f"count(value) FILTER (event_type LIKE '%{w}%') AS {w}_count, avg(value) FILTER (event_type LIKE '%{w}%') AS {w}_mean, stddev_samp(value) FILTER (event_type LIKE '%{w}%') AS {w}_std, max(value) FILTER (event_type LIKE '%{w}%') AS {w}_max, sum(value) FILTER (event_type LIKE '%{w}%') AS {w}_sum, median(value) FILTER (event_type LIKE '%{w}%') AS {w}_median" for w in ('click', 'err'))} FROM ev GROUP BY 1)
SELECT * FROM w""", "click_mean click_std click_sum click_median err_mean err_std err_sum err_median", digits=8)
def user_keyword_aggs(t):
    e, words = log(t), ["click", "err"]
    out = A.keyword_aggs(e, U, "event_type", "value", words)
    m = A.keyword_medians(e, U, "event_type", "value", words)
    m = m.groupBy(*U).agg(*[F.max(F.when(F.col("word") == w, F.col("median"))).alias(f"{w}_median") for w in words])
    return out.join(m, U, "left")


_TYPES = ("click", "view", "purchase", "error", "signup", "nothing")


@query("session_category_aggs", "A12 A13", f"""
SELECT user_id, {', '.join(f"count(*) FILTER (event_type = '{v}') AS {v}_count, sum(value) FILTER (event_type = '{v}') AS {v}_value_sum, avg(value) FILTER (event_type = '{v}') AS {v}_value_avg, stddev_samp(value) FILTER (event_type = '{v}') AS {v}_value_std, max(value) FILTER (event_type = '{v}') AS {v}_value_max, min(value) FILTER (event_type = '{v}') AS {v}_value_min" for v in _TYPES)},
 avg(value) AS value_mean, stddev_samp(value) AS value_std, sum(value) AS value_sum FROM events GROUP BY 1""",
       " ".join(f"{v}_value_{a}" for v in _TYPES for a in ("sum", "avg", "std")) + " value_mean value_std value_sum", digits=8)
def session_category_aggs(t):
    out = A.category_pivot_aggs(t.events, "user_id", "event_type", _TYPES, "value")
    return out.join(A.numeric_aggs(t.events, "user_id", "value"), "user_id")


@query("user_quantiles_spans", "A14 A15", f"""
WITH {EV}, q AS (SELECT user_id, list_sort(list(value)) AS v, count(value) AS n,
  coalesce(max(us) FILTER (hit = 1) - min(us) FILTER (hit = 1), 0) AS hit_span, coalesce(max(us) FILTER (value > 1e9) - min(us) FILTER (value > 1e9), 0) AS none_span FROM ev GROUP BY 1)
SELECT user_id, v[CAST(round_even(0.1 * (n - 1), 0) AS INT) + 1] AS "value_q0.1", v[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] AS "value_q0.5",
  v[CAST(round_even(0.75 * (n - 1), 0) AS INT) + 1] AS "value_q0.75", hit_span, none_span FROM q""")
def user_quantiles_spans(t):
    e = log(t)
    q = A.quantile_nearest(e, U, "value", [0.1, 0.5, 0.75])
    s = A.conditional_span(e, U, "us", {"hit_span": F.col("hit") == 1, "none_span": F.col("value") > 1e9})
    q = q.toDF("user_id", "value_q01", "value_q05", "value_q075").join(s, U)
    return q.withColumnsRenamed({"value_q01": "value_q0.1", "value_q05": "value_q0.5", "value_q075": "value_q0.75"})


@query("event_value_counts", "A16", """
SELECT event_type, count(*) AS count, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1""", "share")
def event_value_counts(t):
    return A.value_counts(t.events, "event_type", normalize=True)


@query("part_count_of_counts", "A17", """
WITH s AS (SELECT l_partkey, count(*) AS size FROM lineitem GROUP BY 1), c AS (SELECT size, count(*) AS keys FROM s GROUP BY 1)
SELECT size, keys, sum(keys) OVER (ORDER BY size) / sum(keys) OVER () AS cum_share FROM c""", "cum_share")
def part_count_of_counts(t):
    return A.count_of_counts(t.lineitem, "l_partkey")


@query("parts_by_month", "A18", """
SELECT strftime(l_shipdate, '%Y-%m') AS month, count(DISTINCT l_partkey) AS l_partkey_nunique FROM lineitem GROUP BY 1""")
def parts_by_month(t):
    return A.nunique_by_month(t.lineitem, "l_partkey", "l_shipdate")


@query("active_parts", "A19 P19", """
WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= DATE '2001-06-01')
SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) AS code FROM a""")
def active_parts(t):
    return C.label_map(A.active_items(t.lineitem, "l_partkey", "l_shipdate", "2001-06-01"), "l_partkey", start=1)


@query("customer_recency", "A20", """
WITH l AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY 1)
SELECT o_custkey, least(date_diff('day', d, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)), 365) AS recency,
 least(date_diff('day', d, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)), 365) / 365.0 AS recency_scaled FROM l""", "recency_scaled")
def customer_recency(t):
    return A.recency(t.orders, "o_custkey", "o_orderdate", 365)


@query("part_activity", "A21", """
SELECT l_partkey, count(*) AS count, count(*) FILTER (l_returnflag = 'A') AS "l_returnflag_A", count(*) FILTER (l_returnflag = 'N') AS "l_returnflag_N",
 count(*) FILTER (l_returnflag = 'R') AS "l_returnflag_R", """ + ", ".join(f"count(*) FILTER (isodow(l_shipdate) = {i + 1}) AS weekday_{i}" for i in range(7)) + """
FROM lineitem GROUP BY 1""")
def part_activity(t):
    return A.activity_profile(t.lineitem, "l_partkey", "l_shipdate", "l_returnflag", ["A", "N", "R"])


# Region and nation of the supplier against brand and type of the part: 12 levels with the total.
LEVELS = {
    "all": [], "region": ["r_name"], "nation": ["n_name"], "type": ["p_type"], "brand": ["p_brand"],
    "region_type": ["r_name", "p_type"], "region_brand": ["r_name", "p_brand"], "nation_type": ["n_name", "p_type"],
    "nation_brand": ["n_name", "p_brand"], "size": ["p_size"], "region_size": ["r_name", "p_size"], "nation_size": ["n_name", "p_size"],
}
DIMS = ["r_name", "n_name", "p_type", "p_brand", "p_size"]


def sales(t: Tables):
    """Line items with the level columns."""
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    l = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return l.join(s.select("s_suppkey", "n_name", "r_name"), F.col("l_suppkey") == F.col("s_suppkey"))


SALES = """sales AS (SELECT r_name, n_name, p_type, p_brand, p_size, l_quantity, l_shipdate, l_extendedprice FROM lineitem
 JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def level_union(table, value, extra=()):
    """SQL that unions the levels, NULL for columns a level lacks."""
    parts = []
    for name, cols in LEVELS.items():
        dims = ", ".join(c if c in cols else f"CAST(NULL AS {'INT' if c == 'p_size' else 'VARCHAR'}) AS {c}" for c in DIMS)
        group = ", ".join([*cols, *extra])
        parts.append(f"SELECT '{name}' AS level, {dims}, {', '.join([*extra, value])} FROM {table}" + (f" GROUP BY {group}" if group else ""))
    return " UNION ALL ".join(parts)


@query("sales_hierarchy_rollup", "A22", f"WITH {SALES} {level_union('sales', 'sum(l_quantity) AS qty')}")
def sales_hierarchy_rollup(t):
    return A.hierarchy_sum(sales(t), LEVELS, {"qty": "l_quantity"})


@query("sales_hierarchy_weights", "A23", f"""
WITH {SALES}, recent AS (SELECT * FROM sales WHERE l_shipdate > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 28 DAY), u AS ({level_union('recent', 'sum(l_quantity) AS v')})
SELECT level, {', '.join(DIMS)}, v / sum(v) OVER (PARTITION BY level) / 12 AS weight FROM u""", "weight", digits=9)
def sales_hierarchy_weights(t):
    last = t.lineitem.agg(F.max("l_shipdate").alias("last"))
    recent = sales(t).transform(O.attach, last).filter(F.col("l_shipdate") > F.col("last") - F.expr("INTERVAL 28 DAYS"))
    return A.hierarchy_weights(recent, LEVELS, "l_quantity")


@query("supplier_series_scale", "A24", """
WITH sm AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END) AS q FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, min(CASE WHEN q <> 0 THEN month END) OVER (PARTITION BY l_suppkey) AS first FROM sm),
d AS (SELECT l_suppkey, q - lag(q) OVER (PARTITION BY l_suppkey ORDER BY month) AS d FROM f WHERE month >= first)
SELECT l_suppkey, avg(d * d) AS scale FROM d GROUP BY 1""", "scale")
def supplier_series_scale(t):
    q = F.sum(F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(0.0)).alias("q")
    sm = t.lineitem.groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month")).agg(q)
    return A.series_scale(sm, "l_suppkey", "month", "q", split=None)


_RATIOS = {name: {q: 1 + (q - 0.5) * (0.2 + 0.05 * i) for q in (0.025, 0.25, 0.5, 0.75, 0.975)} for i, name in enumerate(LEVELS)}
_RATIO_SQL = ", ".join(f"('{n}', {q!r}::DOUBLE, {r!r}::DOUBLE)" for n, m in _RATIOS.items() for q, r in m.items())


@query("sales_quantile_expand", "A25", f"""
WITH {SALES}, u AS ({level_union('sales', 'sum(l_quantity) AS v')}), r(level, quantile, ratio) AS (VALUES {_RATIO_SQL})
SELECT level, {', '.join(DIMS)}, quantile, v * ratio AS l_quantity FROM u JOIN r USING (level)""", "l_quantity")
def sales_quantile_expand(t):
    return A.quantile_expand(sales(t), LEVELS, "l_quantity", _RATIOS)


@query("order_inverse_weights", "A27 A28", """
WITH b AS (SELECT o_orderkey, o_custkey, round_even(o_totalprice / 1000, -1) AS bin FROM orders)
SELECT o_orderkey, (1 - count(*) OVER (PARTITION BY bin) / count(*) OVER ()) * 2.0 AS freq_weight, 1.0 / count(*) OVER (PARTITION BY o_custkey) AS group_weight FROM b""",
       "freq_weight group_weight")
def order_inverse_weights(t):
    d = A.inverse_freq_weight(bound(t), "price", -1, 2.0, "freq_weight")
    return A.inverse_group_weight(d, "o_custkey", "group_weight").select("o_orderkey", "freq_weight", "group_weight")


@query("customer_top_order", "A29", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def customer_top_order(t):
    return A.argmax_row(t.orders, "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("lineitem_row_stats", "A30 A31", """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_quantity, CAST(l_linenumber AS DOUBLE), l_discount, l_tax] AS a, [l_linenumber % 3, CAST(l_quantity AS INT) % 3, CAST(l_partkey AS INT) % 3] AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_avg(a) AS row_mean, list_min(a) AS row_min, list_max(a) AS row_max, list_stddev_samp(a) AS row_std, list_median(a) AS row_median,
 CASE WHEN m[1] = m[2] OR m[1] = m[3] THEN m[1] WHEN m[2] = m[3] THEN m[2] ELSE m[1] END AS vote FROM v""",
       "row_mean row_std row_median", "vote")
def lineitem_row_stats(t):
    l = t.lineitem.withColumns({"m1": F.col("l_linenumber") % 3, "m2": F.col("l_quantity").cast("int") % 3, "m3": (F.col("l_partkey") % 3).cast("int")})
    out = l.withColumns(A.row_stats(["l_quantity", "l_linenumber", "l_discount", "l_tax"]))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "row_mean", "row_min", "row_max", "row_std", "row_median", A.row_mode(["m1", "m2", "m3"], "vote"))


@query("blended_predictions", "A32 A26", """
WITH p AS (SELECT o_orderkey, o_totalprice / 1000 AS y, 0.7 * (o_custkey % 400) + 0.3 * (o_orderkey % 500) AS price FROM orders)
SELECT round_even(abs(price - y), -1) AS error_bin, count(*) AS count, sqrt(avg((price - y) * (price - y))) AS rmse FROM p GROUP BY 1""", "rmse")
def blended_predictions(t):
    o = bound(t)
    a = o.select("o_orderkey", (F.col("o_custkey") % 400).cast("decimal(3,0)").alias("price"))
    b = o.select("o_orderkey", (F.col("o_orderkey") % 500).cast("decimal(3,0)").alias("price"))
    p = A.blend([a, b], "o_orderkey", "price", [0.7, 0.3]).withColumn("price", F.col("price").cast("double"))
    return A.error_by_group(p.join(o.select("o_orderkey", F.col("price").alias("y")), "o_orderkey"), None, "y", "price", bin_digits=-1)


@query("orders_describe", "A33", """
SELECT 'price' AS "column", count(*) AS count, avg(o_totalprice / 1000) AS mean, stddev_samp(o_totalprice / 1000) AS std, min(o_totalprice / 1000) AS min, max(o_totalprice / 1000) AS max,
 quantile_cont(o_totalprice / 1000, 0.25) AS q25, quantile_cont(o_totalprice / 1000, 0.5) AS q50, quantile_cont(o_totalprice / 1000, 0.75) AS q75,
 CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM orders
UNION ALL SELECT 'o_orderpriority', (SELECT count(*) FROM orders), NULL, NULL, NULL, NULL, NULL, NULL, NULL, (SELECT count(DISTINCT o_orderpriority) FROM orders), o_orderpriority, n
 FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)""", "mean std min max q25 q50 q75")
def orders_describe(t):
    return A.describe(bound(t), ["price"], ["o_orderpriority"])


# cleaning


@query("event_null_fill", "P3 P1", """
WITH g AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS kind FROM events)
SELECT event_id, coalesce(v, (SELECT avg(v) FROM g)) AS v, coalesce(kind, 'type_null') AS kind FROM g""", "v")
def event_null_fill(t):
    g = t.events.select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("kind")
    )
    return C.fill_null(C.fill_null(g, {"kind": "type_null"}), "mean", "v")


@query("text_dates", "F15 F16", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) AS seconds, floor(o_totalprice * 25) / 25.0 AS frame_start FROM orders""", "frame_start", digits=4)
def text_dates(t):
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    return t.orders.select(
        "o_orderkey", S.parse_date(text, "dd/MM/yyyy").alias("day"), S.epoch(text, "dd/MM/yyyy").alias("seconds"),
        S.frame_to_time(S.time_to_frame("o_totalprice", 25.0), 25.0).alias("frame_start"))


@query("order_column_profile", "P7 P8 P9", """
WITH g AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS a, o_orderstatus AS b, o_totalprice / 1000 AS c, 7 AS d FROM orders)
SELECT 'a' AS "column", avg(CAST(a IS NULL AS INT)) AS null_rate, count(DISTINCT a) AS "distinct", var_samp(a) AS variance, CAST(min(a) AS DOUBLE) AS min, CAST(max(a) AS DOUBLE) AS max FROM g
UNION ALL SELECT 'b', 0, count(DISTINCT b), NULL, NULL, NULL FROM g UNION ALL SELECT 'c', 0, count(DISTINCT c), var_samp(c), min(c), max(c) FROM g
UNION ALL SELECT 'd', 0, count(DISTINCT d), var_samp(d), min(d), max(d) FROM g""", "null_rate variance min max")
def order_column_profile(t):
    g = t.orders.select(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("a"), F.col("o_orderstatus").alias("b"), (F.col("o_totalprice") / 1000).alias("c"), F.lit(7).alias("d"))
    return C.column_profile(g)


@query("lineitem_correlations", "P10 P11", """
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL
SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL
SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem UNION ALL
SELECT 'l_quantity', 'target', corr(l_quantity, l_tax) FROM lineitem""", "r")
def lineitem_correlations(t):
    pairs = C.corr_pairs(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    y = C.target_corr(t.lineitem, ["l_quantity"], "l_tax")
    return pairs.unionByName(y.select(F.col("column").alias("a"), F.lit("target").alias("b"), "r"))


@query("lineitem_kept_columns", "P7 P8 P9 P10", """
SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount FROM lineitem""", "quantity discount")
def lineitem_kept_columns(t):
    """Column filters in turn: mostly NULL, constant, hardly varying, and copies of an earlier column."""
    g = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.when(F.col("l_linenumber") > 4, F.col("l_tax")).alias("mostly_null"),
        F.lit(7).alias("constant"), (F.col("l_tax") / 1000).alias("still"), (F.col("l_quantity") * 2 + F.col("l_discount")).alias("copy"))
    g = g.drop(*C.high_null_cols(g, 0.5))
    g = g.drop(*C.low_unique_cols(g, 1))
    g = g.drop(*C.low_variance_cols(g, 1e-6))
    return g.drop(*C.high_corr_cols(g, ["quantity", "discount", "copy"], 0.99))


@query("customer_winsorize", "P12 P13", """
WITH o AS (SELECT *, o_totalprice / 1000 AS p FROM orders), q AS (SELECT o_custkey, quantile_cont(p, 0.05) AS lo, quantile_cont(p, 0.95) AS hi FROM o GROUP BY 1)
SELECT o_orderkey, CASE WHEN p < lo THEN lo WHEN p > hi THEN hi ELSE p END AS price FROM o JOIN q USING (o_custkey)""", "price", digits=9)
def customer_winsorize(t):
    return C.winsorize(bound(t), "o_custkey", "price").select("o_orderkey", "price")


@query("supplier_winsorize_live", "P14", """
WITH sm AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END) AS q FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, min(CASE WHEN q <> 0 THEN month END) OVER (PARTITION BY l_suppkey) AS first FROM sm),
b AS (SELECT l_suppkey, quantile_cont(q, 0.01) AS lo, quantile_cont(q, 0.99) AS hi FROM f WHERE month >= first GROUP BY 1)
SELECT l_suppkey, month, round_even(least(greatest(q, lo), hi), 0) AS q FROM sm JOIN b USING (l_suppkey)""")
def supplier_winsorize_live(t):
    q = F.sum(F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(0.0)).alias("q")
    sm = t.lineitem.groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month")).agg(q)
    return C.winsorize(sm, "l_suppkey", "q", 0.01, 0.99, ["month"], True, 0)


@query("part_bins", "P15 P16 P6", """
WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, floor(1 + log2(count(*))) AS n FROM part)
SELECT p_partkey, least(greatest(ceil((p_retailprice - lo) / (hi - lo) * n), 1), n) - 1 AS bin, round_even(least(greatest(p_retailprice, 1000), 1500) , -1) AS rounded,
 CAST(round_even(p_size / 5.0, 0) * 5 AS BIGINT) AS size5, CASE WHEN p_size % 2 = 0 THEN 0.0 ELSE p_retailprice / (p_size % 2) END AS ratio FROM part, s""", "rounded ratio", "bin")
def part_bins(t):
    d = C.equal_width_bin(t.part, "p_retailprice")
    return d.select("p_partkey", "bin", S.round_bin("p_retailprice", -1, 1000.0, 1500.0).alias("rounded"), S.round_to("p_size", 5).alias("size5"),
                    S.div0(F.col("p_retailprice"), F.col("p_size") % 2).alias("ratio"))


@query("segment_codes", "P17 P18 P20 S20", """
WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer),
v AS (SELECT seg, row_number() OVER (ORDER BY seg) - 1 AS code FROM (SELECT DISTINCT seg FROM g WHERE seg IS NOT NULL)),
f AS (SELECT seg, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS first_code FROM g WHERE seg IS NOT NULL GROUP BY 1)
SELECT c_custkey, CASE WHEN seg IS NULL THEN (SELECT max(code) + 1 FROM v) ELSE code END AS code, code AS code_or_null, coalesce(first_code, -1) AS first_code
FROM g LEFT JOIN v USING (seg) LEFT JOIN f USING (seg)""")
def segment_codes(t):
    g = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("seg"))
    d = C.label_encode(g, "seg", name="code")
    d = C.label_encode(d, "seg", keep_null=True, name="code_or_null")
    return C.factorize(d, "seg", "c_custkey", "first_code").drop("seg")


@query("part_hot_columns", "P21 P22 P23 P25 P29", """
SELECT p_partkey, CAST(p_type = 'ECONOMY' AS INT) AS p_type_ECONOMY, CAST(p_type = 'SMALL' AS INT) AS p_type_SMALL,
 CAST(list_contains(string_split(p_name, ' '), 'red') AS INT) AS p_name_red, CAST(list_contains(string_split(p_name, ' '), 'ring') AS INT) AS p_name_ring,
 CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 ELSE 0 END AS type_code, p_brand IN ('Brand#1', 'Brand#2') AS listed, p_name LIKE '%re%' AND p_name LIKE '%ng%' AS both FROM part""",
       ints="p_type_ECONOMY p_type_SMALL p_name_red p_name_ring type_code")
def part_hot_columns(t):
    d = C.multi_hot(C.one_hot(t.part, "p_type", ["ECONOMY", "SMALL"]), "p_name", ["red", "ring"])
    d = C.recode(d, "p_type", {"ECONOMY": 1, "SMALL": 2}, 0, "type_code")
    d = d.withColumns({"listed": F.col("p_brand").isin("Brand#1", "Brand#2"), "both": S.matches_all("p_name", ["re", "ng"])})
    return d.drop("p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query("event_dedupe", "P26 P27", f"""
WITH {EV}, d AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) > 1 AS duplicated, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us DESC, event_id DESC) AS rn FROM ev)
SELECT user_id, event_type, event_id, duplicated FROM d WHERE rn = 1""")
def event_dedupe(t):
    d = C.duplicated(log(t), ["user_id", "event_type"])
    return C.dedupe(d, ["user_id", "event_type"], UO, "last").select("user_id", "event_type", "event_id", "duplicated")


@query("event_filters", "P4 P28 P36 P37 S6", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 4 AS INT) END AS code FROM events
WHERE event_type <> 'view' AND value > 5 AND value < 80 AND event_id % 11 <> 0""", ints="code")
def event_filters(t):
    e = t.events.select("event_id", "event_type", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("val_x"))
    e = C.drop_null_target(C.drop_null_rows(e, "^val_"), "val_x").filter("event_type <> 'view' AND val_x > 5 AND val_x < 80")
    raw = F.when(F.col("event_id") % 3 == 0, -1.0).otherwise((F.col("event_id") % 4).cast("double"))
    return e.select("event_id", S.to_int_with_null(raw).alias("code"))


@query("user_replay", "P30 P31", f"""
WITH {EV}, l AS (SELECT *, CAST(floor(event_id / 400) AS BIGINT) - CASE WHEN value > 60 THEN 5 ELSE 0 END AS level FROM ev),
d AS (SELECT *, level < lag(level) OVER (PARTITION BY user_id ORDER BY us, event_id) AS fell FROM l),
s AS (SELECT *, sum(CASE WHEN fell THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS falls, bool_or(coalesce(fell, false)) OVER (PARTITION BY user_id) AS any_fell FROM d)
SELECT user_id, event_id, NOT any_fell AS monotonic FROM s WHERE falls = 0""")
def user_replay(t):
    e = log(t).withColumn("level", F.floor(F.col("event_id") / 400) - F.when(F.col("value") > 60, 5).otherwise(0))
    kept = C.drop_after_regression(e, U, UO, "level")
    return kept.join(C.is_monotonic(e, U, UO, "level"), U).select("user_id", "event_id", "monotonic")


@query("order_narrow_types", "P32", """
SELECT o_orderkey, o_custkey, CAST(o_orderkey % 100 AS TINYINT) AS small FROM orders""", ints="small")
def order_narrow_types(t):
    return C.narrow_types(t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 100).alias("small")))


@query("part_supplier_mirror", "P33 R1", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount AS gain, l_tax AS odds, 1 AS is_raw FROM lineitem UNION ALL
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, -l_discount + 0.0, 1 - l_tax, 0 FROM lineitem""", "gain odds", "is_raw")
def part_supplier_mirror(t):
    l = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_discount").alias("gain"), F.col("l_tax").alias("odds"))
    return C.mirror_augment(l, [("l_partkey", "l_suppkey")], ["gain"], ["odds"])


@query("background_events", "P34", f"""
WITH {EV}, m AS (SELECT user_id, us - 1704067200000000 AS us, lead(us) OVER (PARTITION BY user_id ORDER BY us) - 1704067200000000 AS nxt FROM ev WHERE event_type IN ('click', 'view'))
SELECT user_id, us + (nxt - us) * 0.25::DOUBLE AS us, 'background' AS kind FROM m WHERE nxt IS NOT NULL AND us % 10 < 3""", "us", digits=2)
def background_events(t):
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "view", "end").otherwise(F.col("event_type"))
    e = log(t).select("user_id", (F.col("us") - 1704067200000000).cast("double").alias("us"), kind.alias("kind"))
    draw = F.when(F.col("us") % 10 < 3, 0.25).otherwise(0.9)
    return C.sample_background(e, "user_id", "us", "kind", 0.5, draw=draw)
