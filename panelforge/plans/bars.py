"""Queries on price bars: events of one type and hour as open, high, low, close."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candles as C, metrics as M, ordered as O
from .catalog import Tables, query
from .panel import EV, log

K, H = ["asset"], ["hour"]


def bars(t: Tables):
    e = log(t).withColumn("hour", F.floor(F.col("us") / 3_600_000_000))
    at = F.struct("us", "event_id")
    return e.groupBy(F.col("event_type").alias("asset"), "hour").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
        F.sum("value").alias("volume"), F.count(F.lit(1)).alias("count"))


BARS = f"""{EV}, bars AS (SELECT event_type AS asset, us // 3600000000 AS hour, arg_min(value, (us, event_id)) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, (us, event_id)) AS close, sum(value) AS volume, count(*) AS count FROM ev GROUP BY 1, 2)"""
W = "PARTITION BY asset ORDER BY hour"


def _only(df, *cols):
    return df.select("asset", "hour", *cols)


@query("bar_shadows", "W36", f"""
WITH {BARS} SELECT asset, hour, high - greatest(close, open) AS upper_shadow, least(close, open) - low AS lower_shadow, open - close AS open_sub_close, (high + low) / 2 AS mid FROM bars""",
       "upper_shadow lower_shadow open_sub_close mid")
def bar_shadows(t):
    return _only(C.shadows(bars(t)), "upper_shadow", "lower_shadow", "open_sub_close", "mid")


@query("bar_ratios", "W37 P6", f"""
WITH {BARS}, p AS (SELECT asset, hour, count::DOUBLE AS b, open / count AS o, high / count AS h, low / count AS l, close / count AS c FROM bars)
SELECT asset, hour, b AS base, o AS per_open, h AS per_high, l AS per_low, c AS per_close, ln(1 + CASE WHEN o = 0 THEN 0 ELSE b / o END) AS log_base_open,
 ln(1 + h) * ln(1 + CASE WHEN o = 0 THEN 0 ELSE h / o END) + ln(1 + CASE WHEN c = 0 THEN 0 ELSE l / c END) * ln(1 + CASE WHEN o = 0 THEN 0 ELSE l / o END) AS log_mix,
 c - h AS gap, (c - h) / b AS gap_per FROM p""", "base per_open per_high per_low per_close log_base_open log_mix gap gap_per", digits=9)
def bar_ratios(t):
    return C.ratio_block(bars(t)).drop("open", "high", "low", "close", "volume", "count")


@query("bar_momentum", "W38 W39 W40", f"""
WITH {BARS}, x AS (SELECT *, (high + low + close) / 3 AS tp, row_number() OVER w AS i FROM bars WINDOW w AS ({W})),
y AS (SELECT *, tp - lag(tp) OVER w AS d FROM x WINDOW w AS ({W})),
z AS (SELECT *, list(tp) OVER f AS a, avg(tp) OVER f AS m, count(d) OVER f AS nd, sum(CASE WHEN d > 0 THEN tp * volume ELSE 0 END) OVER f AS up, sum(CASE WHEN d < 0 THEN tp * volume ELSE 0 END) OVER f AS down,
  max(high) OVER f AS hh, min(low) OVER f AS ll, arg_max(i, (high, i)) OVER g AS ih, arg_min(i, (low, -i)) OVER g AS il, count(*) OVER g AS ng FROM y
  WINDOW f AS ({W} ROWS 13 PRECEDING), g AS ({W} ROWS 14 PRECEDING)),
q AS (SELECT *, list_sum(list_transform(a, lambda v: abs(v - m))) / 14 AS dev FROM z)
SELECT asset, hour, (close / lag(close, 10) OVER w - 1) * 100 AS roc_10, close / lag(close, 10) OVER w - 1 AS rocp_10,
 CASE WHEN len(a) = 14 THEN (hh - close) / nullif(hh - ll, 0) * -100 END AS willr,
 CASE WHEN ng = 15 THEN 100.0::DOUBLE * (14 - (i - ih)) / 14 END AS aroon_up, CASE WHEN ng = 15 THEN 100.0::DOUBLE * (14 - (i - il)) / 14 END AS aroon_down,
 CASE WHEN high = low THEN 0 ELSE (close - open) / (high - low) END AS bop,
 CASE WHEN len(a) = 14 THEN CASE WHEN dev = 0 THEN 0 ELSE (tp - m) / (0.015::DOUBLE * dev) END END AS cci,
 CASE WHEN nd = 14 THEN CASE WHEN up + down = 0 THEN 0 ELSE 100 * up / (up + down) END END AS mfi FROM q WINDOW w AS ({W})""",
       "roc_10 rocp_10 willr aroon_up aroon_down bop cci mfi")
def bar_momentum(t):
    b = O.chain(bars(t), K, H, C.roc.step(H), C.willr.step(H), C.aroon.step(H), C.cci.step(H), C.mfi.step(H))
    return _only(C.bop(b), "roc_10", "rocp_10", "willr", "aroon_up", "aroon_down", "bop", "cci", "mfi")


@query("bar_rsi_atr", "W41 W42", f"""
WITH RECURSIVE {BARS}, x AS (SELECT *, row_number() OVER w AS i, close - lag(close) OVER w AS d,
  CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM bars WINDOW w AS ({W})),
s AS (SELECT *, avg(greatest(d, 0)) OVER f AS su, avg(greatest(-d, 0)) OVER f AS sv, avg(tr) OVER f AS st FROM x WINDOW f AS ({W} ROWS 13 PRECEDING)),
r AS (SELECT asset, i, hour, su AS u, sv AS v, st AS a FROM s WHERE i = 15 UNION ALL
  SELECT s.asset, s.i, s.hour, (r.u * 13 + greatest(s.d, 0)) / 14, (r.v * 13 + greatest(-s.d, 0)) / 14, (r.a * 13 + s.tr) / 14 FROM r JOIN s ON s.asset = r.asset AND s.i = r.i + 1)
SELECT x.asset, x.hour, CASE WHEN u + v = 0 THEN 0 ELSE 100 * u / (u + v) END AS rsi, CASE WHEN u + v = 0 THEN 0 ELSE 100 * (u - v) / (u + v) END AS cmo, a AS atr FROM x LEFT JOIN r ON x.asset = r.asset AND x.i = r.i""",
       "rsi cmo atr")
def bar_rsi_atr(t):
    return _only(O.chain(bars(t), K, H, C.rsi.step(H), C.atr.step(H)), "rsi", "cmo", "atr")


@query("bar_directional", "W41", f"""
WITH RECURSIVE {BARS}, x AS (SELECT *, row_number() OVER w AS i, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down,
  greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS ({W})),
m AS (SELECT *, CASE WHEN up > 0 AND up > down THEN up ELSE 0 END AS p, CASE WHEN down > 0 AND down > up THEN down ELSE 0 END AS q FROM x),
s AS (SELECT *, sum(p) OVER f AS sp, sum(q) OVER f AS sq, sum(tr) OVER f AS st FROM m WINDOW f AS ({W} ROWS 12 PRECEDING)),
r AS (SELECT asset, i, hour, sp AS p, sq AS q, st AS t FROM s WHERE i = 14 UNION ALL
  SELECT s.asset, s.i, s.hour, r.p * 13 / 14 + s.p, r.q * 13 / 14 + s.q, r.t * 13 / 14 + s.tr FROM r JOIN s ON s.asset = r.asset AND s.i = r.i + 1),
di AS (SELECT *, CASE WHEN i >= 15 THEN CASE WHEN t = 0 THEN 0 ELSE 100 * p / t END END AS a, CASE WHEN i >= 15 THEN CASE WHEN t = 0 THEN 0 ELSE 100 * q / t END END AS b FROM r),
dx AS (SELECT *, CASE WHEN a + b = 0 THEN 0 ELSE 100 * abs(a - b) / (a + b) END AS dx FROM di),
ds AS (SELECT *, avg(dx) OVER (PARTITION BY asset ORDER BY i ROWS 13 PRECEDING) AS seed FROM dx),
ax AS (SELECT asset, i, seed AS adx FROM ds WHERE i = 28 UNION ALL SELECT ds.asset, ds.i, (ax.adx * 13 + ds.dx) / 14 FROM ax JOIN ds ON ds.asset = ax.asset AND ds.i = ax.i + 1)
SELECT x.asset, x.hour, dx.p AS plus_dm, dx.q AS minus_dm, a AS plus_di, b AS minus_di, dx.dx, ax.adx, (ax.adx + lag(ax.adx, 13) OVER (PARTITION BY x.asset ORDER BY x.i)) / 2 AS adxr
FROM x LEFT JOIN dx ON x.asset = dx.asset AND x.i = dx.i LEFT JOIN ax ON x.asset = ax.asset AND x.i = ax.i""",
       "plus_dm minus_dm plus_di minus_di dx adx adxr")
def bar_directional(t):
    return _only(C.directional(bars(t), K, H), "plus_dm", "minus_dm", "plus_di", "minus_di", "dx", "adx", "adxr")


@query("bar_bands_macd", "W42 W11", f"""
WITH RECURSIVE {BARS}, x AS (SELECT *, row_number() OVER ({W}) AS i FROM bars),
e AS (SELECT asset, i, close AS f, close AS s FROM x WHERE i = 1 UNION ALL
  SELECT x.asset, x.i, e.f * (11 / 13.0::DOUBLE) + x.close * (2 / 13.0::DOUBLE), e.s * (25 / 27.0::DOUBLE) + x.close * (2 / 27.0::DOUBLE) FROM e JOIN x ON x.asset = e.asset AND x.i = e.i + 1),
m AS (SELECT *, f - s AS macd FROM e),
g AS (SELECT asset, i, macd AS sig FROM m WHERE i = 1 UNION ALL SELECT m.asset, m.i, g.sig * 0.8::DOUBLE + m.macd * 0.2::DOUBLE FROM g JOIN m ON m.asset = g.asset AND m.i = g.i + 1),
b AS (SELECT *, count(*) OVER f = 20 AS ok, avg(close) OVER f AS mid, stddev_pop(close) OVER f AS dev, max(high) OVER f AS hh, min(low) OVER f AS ll FROM x WINDOW f AS ({W} ROWS 19 PRECEDING))
SELECT b.asset, hour, CASE WHEN ok THEN mid END AS bb_mid, CASE WHEN ok THEN mid + 2 * dev END AS bb_high, CASE WHEN ok THEN mid - 2 * dev END AS bb_low,
 CASE WHEN ok THEN 4 * dev / mid * 100 END AS bb_width, CASE WHEN ok THEN (close - (mid - 2 * dev)) / nullif(4 * dev, 0) END AS bb_share,
 CASE WHEN ok THEN hh END AS dc_high, CASE WHEN ok THEN ll END AS dc_low, CASE WHEN ok THEN (hh + ll) / 2 END AS dc_mid, macd, sig AS macd_signal, macd - sig AS macd_diff
FROM b JOIN m ON b.asset = m.asset AND b.i = m.i JOIN g ON b.asset = g.asset AND b.i = g.i""",
       "bb_mid bb_high bb_low bb_width bb_share dc_high dc_low dc_mid macd macd_signal macd_diff")
def bar_bands_macd(t):
    return O.chain(bars(t), K, H, C.bands.step(H), C.macd.step(H)).drop("open", "high", "low", "close", "volume", "count", "ema_fast", "ema_slow")


@query("bar_volume_lines", "W42", f"""
WITH {BARS}, x AS (SELECT *, lag(close) OVER w AS prev, (high + low + close) / 3 AS tp FROM bars WINDOW w AS ({W}))
SELECT asset, hour, sum(CASE WHEN close < prev THEN -volume ELSE volume END) OVER u AS obv,
 sum(CASE WHEN high = low THEN 0 ELSE (close - low - (high - close)) / (high - low) END * volume) OVER u AS adi,
 sum(coalesce(volume * ((close - prev) / nullif(prev, 0)), 0)) OVER u AS vpt,
 CASE WHEN count(*) OVER f = 14 THEN sum(tp * volume) OVER f / nullif(sum(volume) OVER f, 0) END AS vwap
FROM x WINDOW u AS ({W} ROWS UNBOUNDED PRECEDING), f AS ({W} ROWS 13 PRECEDING)""", "obv adi vpt vwap", digits=3)
def bar_volume_lines(t):
    return _only(C.volume_lines(bars(t), K, H), "obv", "adi", "vpt", "vwap")


@query("bar_adaptive", "W42", f"""
WITH RECURSIVE {BARS}, x AS (SELECT *, row_number() OVER ({W}) AS i, abs(close - lag(close) OVER ({W})) AS move, abs(close - lag(close, 10) OVER ({W})) AS way,
  close / nullif(lag(close) OVER ({W}), 0) AS grown, coalesce(volume < lag(volume) OVER ({W}), false) AS fewer FROM bars),
s AS (SELECT *, sum(move) OVER ({W} ROWS 9 PRECEDING) AS path FROM x),
c AS (SELECT *, pow(CASE WHEN path = 0 THEN 0 ELSE way / path END * (2 / 3.0::DOUBLE - 2 / 31.0::DOUBLE) + 2 / 31.0::DOUBLE, 2) AS k FROM s),
r AS (SELECT asset, hour, i, CASE WHEN i = 11 THEN close END AS kama, 1000.0::DOUBLE AS nvi FROM c WHERE i = 1 UNION ALL
  SELECT c.asset, c.hour, c.i, CASE WHEN c.i = 11 THEN c.close ELSE r.kama + c.k * (c.close - r.kama) END, CASE WHEN c.fewer AND c.grown IS NOT NULL THEN r.nvi * c.grown ELSE r.nvi END
  FROM r JOIN c ON c.asset = r.asset AND c.i = r.i + 1)
SELECT asset, hour, kama, nvi FROM r""", "kama nvi")
def bar_adaptive(t):
    return _only(C.negative_volume(C.adaptive_mean(bars(t), K, H), K, H), "kama", "nvi")


@query("bar_money_flow", "W42", f"""
WITH RECURSIVE {BARS}, x AS (SELECT *, row_number() OVER ({W}) AS i, CASE WHEN high = low THEN 0 ELSE (close - low - (high - close)) / (high - low) END * volume AS flow,
  (close - lag(close) OVER ({W})) * volume AS fo, (high - lag(high) OVER ({W}) + low - lag(low) OVER ({W})) * (high - low) / nullif(2 * volume, 0) AS ease FROM bars),
r AS (SELECT asset, i, fo AS force FROM x WHERE i = 2 UNION ALL SELECT x.asset, x.i, r.force * (12 / 14.0::DOUBLE) + x.fo * (2 / 14.0::DOUBLE) FROM r JOIN x ON x.asset = r.asset AND x.i = r.i + 1)
SELECT x.asset, hour, CASE WHEN count(*) OVER (PARTITION BY x.asset ORDER BY hour ROWS 19 PRECEDING) = 20 THEN sum(flow) OVER (PARTITION BY x.asset ORDER BY hour ROWS 19 PRECEDING) / nullif(sum(volume) OVER (PARTITION BY x.asset ORDER BY hour ROWS 19 PRECEDING), 0) END AS cmf,
  CASE WHEN x.i > 13 THEN force END AS force, ease, CASE WHEN count(ease) OVER (PARTITION BY x.asset ORDER BY hour ROWS 13 PRECEDING) = 14 THEN avg(ease) OVER (PARTITION BY x.asset ORDER BY hour ROWS 13 PRECEDING) END AS ease_mean
FROM x LEFT JOIN r ON x.asset = r.asset AND x.i = r.i""", "cmf force ease ease_mean")
def bar_money_flow(t):
    return _only(C.money_flow(bars(t), K, H, scale=1), "cmf", "force", "ease", "ease_mean")


@query("bar_stops", "W42", f"""
WITH RECURSIVE {BARS}, x AS (SELECT *, row_number() OVER ({W}) AS i, lag(high) OVER ({W}) AS h1, lag(high, 2) OVER ({W}) AS h2, lag(low) OVER ({W}) AS l1, lag(low, 2) OVER ({W}) AS l2 FROM bars),
r AS (SELECT asset, hour, i, close AS stop, high AS ext, 0.02::DOUBLE AS speed, true AS rising FROM x WHERE i = 1 UNION ALL
  SELECT asset, hour, i, CASE WHEN i = 2 THEN close WHEN crossed THEN ext WHEN rising THEN CASE WHEN l2 < s THEN l2 WHEN l1 < s THEN l1 ELSE s END ELSE CASE WHEN h2 > s THEN h2 WHEN h1 > s THEN h1 ELSE s END END,
    CASE WHEN i = 2 THEN ext WHEN crossed THEN CASE WHEN rising THEN low ELSE high END WHEN rising THEN greatest(ext, high) ELSE least(ext, low) END,
    CASE WHEN i = 2 THEN speed WHEN crossed THEN 0.02::DOUBLE WHEN (rising AND high > ext) OR (NOT rising AND low < ext) THEN least(speed + 0.02::DOUBLE, 0.2::DOUBLE) ELSE speed END,
    CASE WHEN i > 2 AND crossed THEN NOT rising ELSE rising END
  FROM (SELECT x.*, r.ext, r.speed, r.rising, r.stop + r.speed * (r.ext - r.stop) AS s,
      CASE WHEN r.rising THEN x.low < r.stop + r.speed * (r.ext - r.stop) ELSE x.high > r.stop + r.speed * (r.ext - r.stop) END AS crossed
    FROM r JOIN x ON x.asset = r.asset AND x.i = r.i + 1))
SELECT asset, hour, CASE WHEN i > 2 AND rising THEN stop END AS psar_up, CASE WHEN i > 2 AND NOT rising THEN stop END AS psar_down FROM r""", "psar_up psar_down")
def bar_stops(t):
    return _only(C.stop_and_reverse(bars(t), K, H), "psar_up", "psar_down")


@query("bar_weighted_corr", "M4 M12", f"""
WITH {BARS}, s AS (SELECT asset, sum(count) AS w, sum(count * open) AS a, sum(count * close) AS b, sum(count * open * open) AS aa, sum(count * close * close) AS bb, sum(count * open * close) AS ab,
  corr(open, close) AS plain, avg(pow(open - close, 2)) AS mse FROM bars GROUP BY 1)
SELECT asset, (ab / w - a / w * b / w) / sqrt((aa / w - pow(a / w, 2)) * (bb / w - pow(b / w, 2))) AS weighted, plain, mse FROM s""", "weighted plain mse")
def bar_weighted_corr(t):
    b = bars(t)
    w = M.weighted_corr(b, "open", "close", "count", "asset").withColumnRenamed("corr", "weighted")
    p = M.weighted_corr(b, "open", "close", by="asset").withColumnRenamed("corr", "plain")
    return w.join(p, "asset").join(M.mse(b, "open", "close", "asset"), "asset")
