"""Queries on time series: supplier x month quantities, user event histories, price bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A, cleaning as L, ordered as O, windows as N
from .catalog import Tables, query


def supplier_month(t: Tables):
    """Quantity and mean price per supplier and month; one row per month, so keys stay small."""
    month = F.trunc("l_shipdate", "month")
    return t.lineitem.groupBy("l_suppkey", month.alias("month")).agg(
        F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("price")
    )


SM = """sm AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
 sum(l_quantity) AS qty, count(*) AS n, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)"""
K, MO = ["l_suppkey"], ["month"]
W_SM = "PARTITION BY l_suppkey ORDER BY month"


def log(t: Tables):
    """User events; ``hit`` marks purchases, ``us`` is the time in microseconds."""
    e = t.events
    return e.select(
        "event_id", "user_id", "event_type", "value", S.micros("ts").alias("us"),
        (F.col("event_type") == "purchase").cast("int").alias("hit"), "ts",
    )


EV = """ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us,
 CAST(event_type = 'purchase' AS INT) AS hit, ts FROM events)"""
U, UO = ["user_id"], ["us", "event_id"]
W_EV = "PARTITION BY user_id ORDER BY us, event_id"


@query("customer_order_history", "W1 W6 W16 A1 J1", f"""
WITH b AS (SELECT o_custkey, o_orderkey, o_orderdate, sum(l_quantity) AS qty
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
p AS (SELECT o_custkey, avg(qty) AS qty_mean, stddev_samp(qty) AS qty_std, min(qty) AS qty_min, max(qty) AS qty_max,
  arg_min(qty, (o_orderdate, o_orderkey)) AS qty_first, arg_max(qty, (o_orderdate, o_orderkey)) AS qty_last FROM b GROUP BY 1),
w AS (SELECT o_custkey, o_orderkey, qty,
  lag(qty, 1) OVER c AS qty_lag_1, lag(qty, 2) OVER c AS qty_lag_2,
  avg(qty) OVER (c ROWS 2 PRECEDING) AS qty_avg_3,
  avg(qty) OVER (c ROWS UNBOUNDED PRECEDING) AS qty_running_avg
  FROM b WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT * FROM w JOIN p USING (o_custkey)""",
       "qty_mean qty_std qty_avg_3 qty_running_avg")
def customer_order_history(t):
    b = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    b = b.groupBy("o_custkey", "o_orderkey", "o_orderdate").agg(F.sum("l_quantity").alias("qty"))
    k, o = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    cut = O.splitters(t.orders, k, o)  # the series has the orders' keys
    p = A.numeric_profile(b, k, o, "qty")
    w = O.chain(b, k, o, N.lags.step(o, "qty", [1, 2]), N.rolling.step(o, "qty", [3], min_periods=1), split=cut)
    w = O.running(w, k, o, "qty", ["avg"], split=cut)
    return w.drop("o_orderdate").join(p, "o_custkey")


@query("supplier_lags_diffs", "W1 W2 W3 W5", f"""
WITH {SM} SELECT l_suppkey, month, qty,
  lag(qty, 1) OVER c AS qty_lag_1, lag(qty, 3) OVER c AS qty_lag_3, lead(qty, 2) OVER c AS "qty_lag_-2",
  qty - lag(qty, 1) OVER c AS qty_diff_1, qty - lead(qty, 1) OVER c AS "qty_diff_-1",
  CASE WHEN lag(qty, 1) OVER c IS NOT NULL THEN least(greatest(qty / lag(qty, 1) OVER c - 1, -0.5), 0.5) END AS qty_pct_1,
  lag(qty, 3) OVER c - lag(qty, 5) OVER c AS shifted_diff,
  lag(qty, 3) OVER c / lag(qty, 4) OVER c - 1 AS shifted_pct
  FROM sm WINDOW c AS ({W_SM})""", "qty_pct_1 shifted_pct")
def supplier_lags_diffs(t):
    o = MO
    out = O.chain(
        supplier_month(t), K, o, N.lags.step(o, "qty", [1, 3, -2]), N.diffs.step(o, "qty", [1, -1]),
        N.pct_changes.step(o, "qty", [1], -0.5, 0.5),
        N.diffs.step(o, "qty", [2], shift=3, names=lambda c, n: "shifted_diff"),
        N.pct_changes.step(o, "qty", [1], shift=3, names=lambda c, n: "shifted_pct"), split=None,
    )
    return out.drop("n", "price")


@query("supplier_fill_change", "W3 W4 W31", f"""
WITH {SM}, g AS (SELECT l_suppkey, month, CASE WHEN n % 4 = 0 THEN NULL ELSE qty END AS q FROM sm),
f AS (SELECT *, last_value(q IGNORE NULLS) OVER (c ROWS UNBOUNDED PRECEDING) AS ff,
  first_value(q IGNORE NULLS) OVER (c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf,
  last_value(q IGNORE NULLS) OVER (PARTITION BY l_suppkey, year(month) ORDER BY month ROWS UNBOUNDED PRECEDING) AS yf
  FROM g WINDOW c AS ({W_SM}))
SELECT l_suppkey, month, ff, bf, yf, ff / lag(ff) OVER c - 1 AS ff_pct_1,
  CASE WHEN bf = 0 AND lag(bf) OVER c = 0 THEN 0 WHEN lag(bf) OVER c = 0 THEN 1 ELSE abs(bf / lag(bf) OVER c - 1) END AS bf_change
  FROM f WINDOW c AS ({W_SM})""", "ff_pct_1 bf_change")
def supplier_fill_change(t):
    g = supplier_month(t).withColumn("q", F.when(F.col("n") % 4 != 0, F.col("qty")))
    g = g.withColumns({"ff": F.col("q"), "bf": F.col("q"), "yf": F.col("q"), "y": F.year("month")})
    g = N.ffill(g, K, MO, ["ff"], split=None)
    g = N.bfill(g, K, MO, ["bf"], split=None)
    g = N.ffill(g, ["l_suppkey", "y"], MO, ["yf"], split=None)
    g = O.chain(g, K, MO, N.pct_changes.step(MO, "ff", [1]), N.change_ratio.step(MO, "bf"), split=None)
    return g.select("l_suppkey", "month", "ff", "bf", "yf", "ff_pct_1", "bf_change")


@query("supplier_month_rolling", "W6 W7 W12 W14 W15", f"""
WITH {SM}, r AS (SELECT *, lag(qty, 28) OVER c AS l28 FROM sm WINDOW c AS ({W_SM}))
SELECT l_suppkey, month,
  avg(qty) OVER (c ROWS 3 PRECEDING) AS qty_avg_4, sum(qty) OVER (c ROWS 3 PRECEDING) AS qty_sum_4, stddev_samp(qty) OVER (c ROWS 3 PRECEDING) AS qty_std_4,
  CASE WHEN count(qty) OVER s7 = 6 THEN avg(qty) OVER s7 END AS late_avg_6,
  CASE WHEN count(qty) OVER s7 = 6 THEN stddev_samp(qty) OVER s7 END AS late_std_6,
  CASE WHEN count(qty) OVER s7 = 6 THEN min(qty) OVER s7 END AS late_min_6,
  CASE WHEN count(qty) OVER s7 = 6 THEN max(qty) OVER s7 END AS late_max_6,
  CASE WHEN count(qty) OVER m = 5 THEN avg(qty) OVER m END AS mid_avg_5,
  CASE WHEN count(qty) OVER m = 5 THEN quantile_cont(qty, 0.5) OVER m END AS mid_median_5,
  CASE WHEN count(qty) OVER f = 3 THEN sum(qty) OVER f END AS next_sum_3,
  CASE WHEN count(qty) OVER y = 24 THEN qty - max(qty) OVER y END AS below_max_24
FROM r WINDOW c AS ({W_SM}), s7 AS ({W_SM} ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING),
  m AS ({W_SM} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), f AS ({W_SM} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING),
  y AS ({W_SM} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""",
       "qty_avg_4 qty_std_4 late_avg_6 late_std_6 mid_avg_5 mid_median_5")
def supplier_month_rolling(t):
    r = N.rolling.step
    out = O.chain(
        supplier_month(t), K, MO,
        r(MO, "qty", [4], ["avg", "sum", "std"], min_periods=1),
        r(MO, "qty", [6], ["avg", "std", "min", "max"], shift=3, names=lambda a, w: f"late_{a}_{w}"),
        r(MO, "qty", [5], ["avg", "median"], center=True, names=lambda a, w: f"mid_{a}_{w}"),
        r(MO, "qty", [3], ["sum"], forward=True, names=lambda a, w: f"next_{a}_{w}"),
        r(MO, "qty", [24], ["max"], shift=1, names=lambda a, w: "top"), split=None,
    )
    return out.withColumn("below_max_24", F.col("qty") - F.col("top")).drop("n", "price", "qty", "top")


@query("supplier_rolling_shape", "W8 W9 W10 W26", f"""
WITH {SM}, r AS (SELECT *, CAST(row_number() OVER c AS DOUBLE) AS i FROM sm WINDOW c AS ({W_SM}))
SELECT l_suppkey, month,
  CASE WHEN count(qty) OVER d = 12 THEN skewness(qty) OVER d END AS qty_skew_12,
  CASE WHEN count(qty) OVER d = 12 THEN kurtosis(qty) OVER d END AS qty_kurt_12,
  CASE WHEN count(qty) OVER d = 12 THEN len(list_distinct(list(qty) OVER d)) END AS qty_nunique_12,
  CASE WHEN count(*) OVER e = 6 THEN avg(CASE WHEN qty > 200 THEN 1 ELSE 0 END) OVER e END AS rate_6,
  CASE WHEN count(*) OVER e = 6 THEN sum(CASE WHEN qty > 200 THEN 1 ELSE 0 END) OVER e END AS count_6,
  CASE WHEN count(qty) OVER d >= 9 THEN regr_slope(qty, i) OVER d END AS qty_slope_12,
  CASE WHEN count(qty) OVER d >= 9 THEN corr(qty, i) OVER d END AS qty_corr_12,
  CASE WHEN count(qty) OVER d >= 9 THEN pow(corr(qty, i) OVER d, 2) END AS qty_r2_12
FROM r WINDOW d AS ({W_SM} ROWS 11 PRECEDING), e AS ({W_SM} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
       "qty_skew_12 qty_kurt_12 rate_6 qty_slope_12 qty_corr_12 qty_r2_12", "count_6 qty_nunique_12")
def supplier_rolling_shape(t):
    out = O.chain(
        supplier_month(t), K, MO, N.rolling.step(MO, "qty", [12], ["skew", "kurt", "nunique"]),
        N.rolling_rate.step(MO, F.col("qty") > 200, [6], shift=1), N.rolling_slope.step(MO, "qty"), split=None,
    )
    return out.drop("n", "price", "qty")


@query("user_ewm", "W11", f"""
WITH {EV}, r AS (SELECT *, row_number() OVER c AS i FROM ev WINDOW c AS ({W_EV}))
SELECT a.user_id, a.event_id, sum(b.value * pow(0.4, a.i - 1 - b.i)) / sum(pow(0.4, a.i - 1 - b.i)) AS value_ewm
FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.i <= a.i - 1
GROUP BY a.user_id, a.event_id""", "value_ewm")
def user_ewm(t):
    return N.ewm(log(t), U, UO, "value", 0.6, shift=1).select("user_id", "event_id", "value_ewm")


@query("supplier_impute_centered", "W13", f"""
WITH {SM}, g AS (SELECT l_suppkey, month, CASE WHEN n % 4 = 0 THEN NULL ELSE qty END AS q FROM sm)
SELECT l_suppkey, month, CAST(q IS NULL AS INT) AS q_missing,
  coalesce(q, CASE WHEN count(*) OVER m = 3 AND count(q) OVER m = 2 THEN avg(q) OVER m END, 0) AS q_imputed
FROM g WINDOW m AS ({W_SM} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""", "q_imputed", "q_missing")
def supplier_impute_centered(t):
    g = supplier_month(t).withColumn("q", F.when(F.col("n") % 4 != 0, F.col("qty")))
    return N.impute_centered(g, K, MO, "q", split=None).select("l_suppkey", "month", "q_missing", "q_imputed")


@query("user_running_stats", "W16 W17 W20 W22", f"""
WITH {EV} SELECT user_id, event_id,
  count(value) OVER a AS value_running_count, sum(value) OVER a AS value_running_sum, avg(value) OVER a AS value_running_avg,
  stddev_samp(value) OVER a AS value_running_std_samp, max(value) OVER a AS value_running_max,
  avg(value) OVER b AS value_past_avg, stddev_pop(value) OVER b AS value_past_std_pop, avg(hit) OVER b AS hit_past_avg,
  sum(hit) OVER b AS hit_past_sum,
  CASE WHEN hit = 1 THEN count(value) OVER b / (event_id + 1) END AS done_share
FROM ev WINDOW a AS ({W_EV} ROWS UNBOUNDED PRECEDING), b AS ({W_EV} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
       "value_running_sum value_running_avg value_running_std_samp value_past_avg value_past_std_pop hit_past_avg done_share", "hit_past_sum", digits=9)
def user_running_stats(t):
    e = log(t)
    cut = O.splitters(e, U, UO)
    d = O.running(e, U, UO, "value", ["count", "sum", "avg", "std_samp", "max"], split=cut)
    past = lambda c, a: f"{c}_past_{a}"
    d = O.running(d, U, UO, "value", ["avg", "std_pop", "count"], exclude_current=True, names=past, split=cut)
    d = O.running(d, U, UO, "hit", ["avg", "sum"], exclude_current=True, names=past, split=cut)
    d = d.withColumn("done_share", F.when(F.col("hit") == 1, F.col("value_past_count") / (F.col("event_id") + 1)))
    return d.drop("event_type", "value", "us", "hit", "ts", "value_past_count")


@query("user_recent_past", "W18 W19", f"""
WITH {EV} SELECT user_id, event_id,
  CASE WHEN lag(1, 6) OVER c IS NOT NULL THEN avg(value) OVER a END AS value_avg_last_5,
  CASE WHEN lag(1, 6) OVER c IS NOT NULL THEN stddev_pop(value) OVER a END AS value_std_last_5,
  CASE WHEN lag(1, 11) OVER c IS NOT NULL THEN avg(value) OVER b END AS value_avg_last_10,
  CASE WHEN lag(1, 11) OVER c IS NOT NULL THEN stddev_pop(value) OVER b END AS value_std_last_10,
  lag(us, 1) OVER c - lag(us, 2) OVER c AS us_gap_0, lag(us, 2) OVER c - lag(us, 3) OVER c AS us_gap_1, lag(us, 3) OVER c - lag(us, 4) OVER c AS us_gap_2
FROM ev WINDOW c AS ({W_EV}), a AS ({W_EV} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b AS ({W_EV} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
       "value_avg_last_5 value_std_last_5 value_avg_last_10 value_std_last_10")
def user_recent_past(t):
    d = O.chain(log(t), U, UO, N.recent_past.step(UO, "value", [5, 10]), N.past_gaps.step(UO, "us", 3))
    return d.drop("event_type", "value", "us", "hit", "ts")


@query("user_positions", "W21 W23 W25", f"""
WITH {EV}, r AS (SELECT user_id, event_id, row_number() OVER ({W_EV}) - 1 AS cumcount, (row_number() OVER ({W_EV}) - 1) % 12 AS phase,
  row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS back FROM ev)
SELECT user_id, event_id, cumcount, phase, back FROM r WHERE back <= 3""")
def user_positions(t):
    d = N.cumcount(log(t), U, UO)
    d = d.withColumn("phase", F.col("cumcount") % 12)
    return A.tail_rows(d, U, UO, 3).select("user_id", "event_id", "cumcount", "phase", F.col("_back").alias("back"))


@query("part_price_rank", "W24", """
SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS size_rank FROM part""",
       "size_rank")
def part_price_rank(t):
    return N.rank_avg(t.part, "p_brand", "p_size", "size_rank").select("p_partkey", "p_brand", "size_rank")


@query("supplier_group_transform", "W26 E1", f"""
WITH {SM} SELECT l_suppkey, month, avg(qty) OVER k AS qty_mean, stddev_samp(qty) OVER k AS qty_std, min(qty) OVER k AS qty_min,
  max(qty) OVER k AS qty_max, (SELECT count(DISTINCT qty) FROM sm x WHERE x.l_suppkey = sm.l_suppkey) AS qty_nunique
FROM sm WINDOW k AS (PARTITION BY l_suppkey)""", "qty_mean qty_std")
def supplier_group_transform(t):
    out = N.transform_agg(supplier_month(t), "l_suppkey", {
        "qty_mean": F.avg("qty"), "qty_std": F.stddev_samp("qty"), "qty_min": F.min("qty"),
        "qty_max": F.max("qty"), "qty_nunique": F.count_distinct("qty"),
    })
    return out.drop("qty", "n", "price")


@query("supplier_price_features", "W27 F18", f"""
WITH {SM}, d AS (SELECT *, CAST(date_diff('month', DATE '1990-01-01', month) AS BIGINT) AS mi FROM sm)
SELECT l_suppkey, month, price / lag(price) OVER c AS price_to_prev, floor(price) AS price_whole, price - floor(price) AS price_frac,
  price / max(price) OVER k AS price_to_max, price / avg(price) OVER (PARTITION BY month) AS price_to_mean, mi - min(mi) OVER k AS since_release
FROM d WINDOW c AS ({W_SM}), k AS (PARTITION BY l_suppkey)""", "price_to_prev price_frac price_to_max price_to_mean")
def supplier_price_features(t):
    d = supplier_month(t)
    d = d.withColumn("mi", F.months_between("month", F.lit("1990-01-01").cast("date")).cast("bigint"))
    d = N.price_relatives(d, K, MO, "price", split=None)
    d = N.transform_agg(d, K, {"top": F.max("price")})
    d = N.transform_agg(d, MO, {"mean": F.avg("price")})
    d = N.weeks_since_first(d, K, "mi", "since_release")
    d = d.withColumns({"price_to_max": F.col("price") / F.col("top"), "price_to_mean": F.col("price") / F.col("mean")})
    return d.drop("qty", "n", "price", "mi", "top", "mean")


@query("user_since_last", "W28 P35", f"""
WITH {EV}, r AS (SELECT user_id, event_id, value, CAST(row_number() OVER ({W_EV}) AS BIGINT) AS pos, hit, us FROM ev),
s AS (SELECT *, pos - max(CASE WHEN hit = 1 THEN pos END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS since_last,
  pos - max(CASE WHEN hit = 1 THEN pos END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS since_before FROM r)
SELECT user_id, event_id, since_last, since_before, CASE WHEN since_last > 4 THEN NULL ELSE value END AS live_value FROM s""")
def user_since_last(t):
    e = log(t)
    cut = O.splitters(e, U, UO)
    d = O.positions(e, U, UO, split=cut)
    d = N.since_last(d, U, UO, "pos", F.col("hit") == 1, split=cut)
    d = N.since_last(d, U, UO, "pos", F.col("hit") == 1, shift=2, name="since_before", split=cut)
    d = L.mask_inactive(d.withColumn("live_value", F.col("value")), "since_last", "live_value", 4)
    return d.select("user_id", "event_id", "since_last", "since_before", "live_value")


@query("order_decay_weight", "W29 W33", """
WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS hi, min(CAST(o_orderdate AS DATE)) AS lo FROM orders)
SELECT o_orderkey, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), hi) < 365 THEN 1.0
   ELSE 1.0 - 0.0005 * (date_diff('day', CAST(o_orderdate AS DATE), hi) - 364) END::DOUBLE AS weight,
  date_diff('day', CAST(o_orderdate AS DATE), hi) // 7 + 1 AS week,
  (date_diff('day', CAST(o_orderdate AS DATE), hi) // 7 + 1) / (date_diff('day', lo, hi) // 7 + 1) AS week_scaled
FROM orders, m""", "weight week_scaled")
def order_decay_weight(t):
    d = t.orders.withColumn("d", F.unix_date(F.to_date("o_orderdate")))
    d = N.decay_weight(d, "d", 365)
    return N.weeks_before_latest(d, "o_orderdate").select("o_orderkey", "weight", "week", "week_scaled")


@query("supplier_share_weight", "W30", f"""
WITH {SM}, s AS (SELECT *, avg(n) OVER (PARTITION BY l_suppkey) AS scale,
  CASE WHEN count(qty) OVER f = 4 THEN sum(qty) OVER f END AS r FROM sm WINDOW f AS ({W_SM} ROWS 3 PRECEDING)),
v AS (SELECT l_suppkey, month, r / sum(r) OVER (PARTITION BY month) * scale AS w FROM s)
SELECT l_suppkey, month, (w - min(w) OVER m) / nullif(max(w) OVER m - min(w) OVER m, 0) AS weight FROM v WINDOW m AS (PARTITION BY month)""", "weight")
def supplier_share_weight(t):
    d = N.transform_agg(supplier_month(t), K, {"scale": F.avg("n")})
    return N.rolling_share_weight(d, K, MO, "qty", "scale", 4).select("l_suppkey", "month", "weight")


@query("supplier_sample_weight", "W30", f"""
WITH {SM}, z AS (SELECT *, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 3 = 0 THEN 0 ELSE n END::DOUBLE AS x FROM sm),
f AS (SELECT *, list_filter(list(x) OVER ({W_SM} ROWS 11 PRECEDING), lambda v: v IS NOT NULL) AS l,
  CASE WHEN count(qty) OVER ({W_SM} ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) = 4 THEN sum(qty) OVER ({W_SM} ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) END AS recent FROM z),
g AS (SELECT *, CASE WHEN len(l) < 4 THEN [] ELSE l[coalesce(list_position(list_transform(l, lambda v: v <> 0), true), 1) :] END AS s FROM f),
h AS (SELECT l_suppkey, month, recent / sum(recent) OVER (PARTITION BY month) AS share,
  coalesce(list_avg(list_transform(range(2, len(s) + 1), lambda i: pow(s[i] - s[i - 1], 2))), 0) AS scale FROM g),
w AS (SELECT *, coalesce(share, 0) / (sqrt(scale) + 1) AS w FROM h)
SELECT l_suppkey, month, scale, (w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()) AS weight FROM w""", "scale weight")
def supplier_sample_weight(t):
    x = F.when(F.col("n") % 7 != 0, F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("n")))
    d = supplier_month(t).withColumn("x", x)
    w = N.sample_weight(d, K, MO, "x", "qty", 4, 2, 12, 4)
    return N.rolling_scale(w, K, MO, "x", 12, 4).select("l_suppkey", "month", "scale", "weight")


@query("supplier_log_return", "W32", f"""
WITH {SM} SELECT l_suppkey, month, ln(qty) - ln(lag(qty, 2) OVER c) AS ret, abs(ln(qty) - ln(lag(qty) OVER c)) AS abs_ret FROM sm WINDOW c AS ({W_SM})""", "ret abs_ret")
def supplier_log_return(t):
    d = O.chain(supplier_month(t), K, MO, N.log_return.step(MO, "qty", 2, name="ret"), N.log_return.step(MO, "qty", 1, True, "abs_ret"), split=None)
    return d.drop("qty", "n", "price")


@query("customer_visit_index", "W34", """
SELECT o_orderkey, least(dense_rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)), 5) AS visit FROM orders""")
def customer_visit_index(t):
    return N.visit_index(t.orders, "o_custkey", "o_orderdate", 5).select("o_orderkey", "visit")


@query("supplier_supervised", "W35 Q12", f"""
WITH {SM}, r AS (SELECT l_suppkey, month, qty, n, lag(qty, 2) OVER c AS qty_t_2, lag(n, 2) OVER c AS n_t_2, lag(qty, 1) OVER c AS qty_t_1, lag(n, 1) OVER c AS n_t_1,
  list(qty) OVER (c ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS "window" FROM sm WINDOW c AS ({W_SM}))
SELECT *, qty AS next_value FROM r WHERE qty_t_2 IS NOT NULL AND len("window") = 3""")
def supplier_supervised(t):
    d = O.chain(supplier_month(t), K, MO, N.supervised.step(MO, ["qty", "n"], 2), split=None)
    w = N.window_pairs(supplier_month(t), K, MO, "qty", 3, split=None).select("l_suppkey", "month", "window", "next_value")
    return d.drop("price").join(w, ["l_suppkey", "month"])


@query("user_rolling_apply", "U2", f"""
WITH {EV} SELECT user_id, event_id, CASE WHEN count(value) OVER c = 4 THEN max(value) OVER c - min(value) OVER c END AS value_range
FROM ev WINDOW c AS ({W_EV} ROWS 3 PRECEDING)""", "value_range")
def user_rolling_apply(t):
    spread = lambda a: F.array_max(a) - F.array_min(a)
    return N.rolling_apply(log(t), U, UO, "value", 4, spread, "value_range").select("user_id", "event_id", "value_range")
