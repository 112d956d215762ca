"""Price-bar indicators per asset, ordered by time.

The smoothers weigh old rows less and less. A weight that a double holds as 0 ends the reach, so smoothing
looks a fixed number of rows back; which value is a key's n-th is counted over its whole past.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window as W, functions as F

from ..functions.scalars import div0
from .ordered import AUTO, Step, by_key, held, running, windowed
from .scans import affine, machine
from .windows import decay_reach, decayed_sums


def _w(ks, order):
    return W.partitionBy(*ks).orderBy(*order)


def _full(c, f, n):
    return F.count(F.lit(1)).over(f) == n


def shadows(df):
    """Upper and lower shadow, open minus close, mid price."""
    return df.withColumns({
        "upper_shadow": F.col("high") - F.greatest("close", "open"),
        "lower_shadow": F.least("close", "open") - F.col("low"),
        "open_sub_close": F.col("open") - F.col("close"),
        "mid": (F.col("high") + F.col("low")) / 2,
    })


def ratio_block(df):
    """Prices over the trade count and their log ratios; a division by 0 gives 0."""
    b = F.col("count").cast("double")
    o, h, l, c = (div0(x, b) for x in ("open", "high", "low", "close"))
    return df.withColumns({
        "base": b, "per_open": o, "per_high": h, "per_low": l, "per_close": c,
        "log_base_open": F.log1p(div0(b, o)),
        "log_mix": F.log1p(h) * F.log1p(div0(h, o)) + F.log1p(div0(l, c)) * F.log1p(div0(l, o)),
        "gap": c - h, "gap_per": div0(c - h, b),
    })


@windowed
def roc(order, col="close", n=10):
    """Rate of change in percent, and as a share."""
    def fn(d, ks):
        share = F.try_divide(F.col(col), F.lag(col, n).over(_w(ks, order))) - 1
        return d.withColumns({f"roc_{n}": share * 100, f"rocp_{n}": share})

    return Step(n, 0, fn)


@windowed
def willr(order, n=14):
    """Williams %R over n rows."""
    def fn(d, ks):
        f = _w(ks, order).rowsBetween(-(n - 1), 0)
        hi, lo = F.max("high").over(f), F.min("low").over(f)
        return d.withColumn("willr", F.when(_full("high", f, n), F.try_divide(hi - F.col("close"), hi - lo) * -100))

    return Step(n - 1, 0, fn)


@windowed
def aroon(order, n=14):
    """Rows since the highest high and lowest low of the last n + 1 rows, as 0..100; the latest of equals counts."""
    def fn(d, ks):
        d = d.withColumn("_i", F.row_number().over(_w(ks, order)))
        f = _w(ks, order).rowsBetween(-n, 0)
        top = F.max(F.struct("high", "_i")).over(f)["_i"]
        low = -F.min(F.struct(F.col("low"), (-F.col("_i")).alias("j"))).over(f)["j"]
        full = F.count(F.lit(1)).over(f) == n + 1
        since = lambda at: F.when(full, 100.0 * (n - (F.col("_i") - at)) / n)
        return d.withColumns({"aroon_up": since(top), "aroon_down": since(low)}).drop("_i")

    return Step(n, 0, fn)


def bop(df):
    """Balance of power; 0 for a flat bar."""
    return df.withColumn("bop", div0(F.col("close") - F.col("open"), F.col("high") - F.col("low")))


def _typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


@windowed
def cci(order, n=14):
    """Commodity channel index; 0 without deviation."""
    def fn(d, ks):
        f = _w(ks, order).rowsBetween(-(n - 1), 0)
        d = d.withColumn("_tp", _typical())
        d = d.withColumns({"_a": F.collect_list("_tp").over(f), "_m": F.avg("_tp").over(f)})
        dev = F.aggregate("_a", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_m"))) / n
        out = F.when(F.size("_a") == n, F.when(dev == 0, 0.0).otherwise((F.col("_tp") - F.col("_m")) / (0.015 * dev)))
        return d.withColumn("cci", out).drop("_tp", "_a", "_m")

    return Step(n - 1, 0, fn)


@windowed
def mfi(order, n=14):
    """Money-flow index over n moves."""
    def fn(d, ks):
        w, f = _w(ks, order), _w(ks, order).rowsBetween(-(n - 1), 0)
        d = d.withColumn("_tp", _typical())
        d = d.withColumn("_d", F.col("_tp") - F.lag("_tp").over(w))
        flow = F.col("_tp") * F.col("volume")
        up, down = F.when(F.col("_d") > 0, flow).otherwise(0.0), F.when(F.col("_d") < 0, flow).otherwise(0.0)
        u, v = F.sum(up).over(f), F.sum(down).over(f)
        return d.withColumn("mfi", F.when(F.count("_d").over(f) == n, F.when(u + v == 0, 0.0).otherwise(100 * u / (u + v)))).drop("_tp", "_d")

    return Step(n, 0, fn)


def _smooth(d, pairs: dict[str, str], n: int, ks, order, first: Column):
    """Recursive smoothing of period n: the mean of the first n values, then
    s x (n-1)/n + x/n. ``first`` counts the key's values up to the row, over its whole
    past. ``pairs`` maps the result to its input.
    """
    seed = lambda c: F.sum(c).over(_w(ks, order).rowsBetween(-(n - 1), 0))
    entry = lambda c: F.when(first == n, seed(c) / n).when(first > n, F.col(c) / n)
    d = decayed_sums(d, {out: entry(c) for out, c in pairs.items()}, 1 - 1 / n, ks, order)
    return d.withColumns({out: F.when(first >= n, F.col(out)) for out in pairs})


def _counted(order, *rounds: dict[str, Callable]):
    """A ``prepare`` that adds running counts of the non-NULL values of expressions over all rows so far.

    Each round maps names to ``expr(window)``, which may look one row back and use the names of earlier rounds.
    """
    def prepare(df, keys, split):
        for exprs in rounds:
            parts = {f"_c{n}": e for n, e in exprs.items()}
            df = held(by_key(df, keys, order, lambda d, ks, p=parts: d.withColumns({n: e(_w(ks, order)) for n, e in p.items()}), before=1, split=split), split)
            df = held(running(df, keys, order, list(parts), ["count"], split=split, names=lambda c, a: c[2:]).drop(*parts), split)
        return df

    return prepare


def _range(w):
    """True range; NULL on the first row."""
    prev = F.lag("close").over(w)
    return F.when(prev.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


@windowed
def rsi(order, col="close", n=14):
    """Relative strength index and Chande momentum oscillator, Wilder smoothing."""
    count = f"_moves_{col}"

    def fn(d, ks):
        d = d.withColumn("_d", F.col(col) - F.lag(col).over(_w(ks, order)))
        d = d.withColumns({"_u": F.greatest("_d", F.lit(0.0)), "_v": F.greatest(-F.col("_d"), F.lit(0.0))})
        d = d.withColumn("_k", F.col(count))
        d = _smooth(d, {"_su": "_u", "_sv": "_v"}, n, ks, order, F.col("_k"))
        u, v = F.col("_su"), F.col("_sv")
        return d.withColumns({
            "rsi": F.when(u + v == 0, 0.0).otherwise(100 * u / (u + v)),
            "cmo": F.when(u + v == 0, 0.0).otherwise(100 * (u - v) / (u + v)),
        }).drop("_d", "_u", "_v", "_k", "_su", "_sv", count)

    return Step(decay_reach(1 - 1 / n) + n + 1, 0, fn, _counted(order, {count: lambda w: F.col(col) - F.lag(col).over(w)}))


@windowed
def directional(order, n=14):
    """Directional movement (plus_dm, minus_dm), indicators (plus_di, minus_di), dx, adx and adxr.

    Movement and true range are sums decaying by (n-1)/n from the first n-1 moves.
    """
    decay = 1 - 1 / n
    counts = {"_ranges": _range}, {"_seen": lambda w: F.when(F.col("_ranges") >= n, 1)}

    def fn(d, ks):
        w = _w(ks, order)
        up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
        d = d.withColumns({
            "_p": F.when((up > 0) & (up > down), up).when(up.isNotNull(), 0.0),
            "_m": F.when((down > 0) & (down > up), down).when(up.isNotNull(), 0.0),
            "_t": _range(w),
        })
        d = d.withColumn("_k", F.col("_ranges"))
        seed = lambda c: F.sum(c).over(w.rowsBetween(-(n - 2), 0))
        entry = lambda c: F.when(F.col("_k") == n - 1, seed(c)).when(F.col("_k") > n - 1, F.col(c))
        d = decayed_sums(d, {f"{c}s": entry(c) for c in ("_p", "_m", "_t")}, decay, ks, order)
        d = d.withColumns({f"{c}s": F.when(F.col("_k") >= n - 1, F.col(f"{c}s")) for c in ("_p", "_m", "_t")})
        seen = F.col("_k") >= n
        p, m, t = F.col("_ps"), F.col("_ms"), F.col("_ts")
        d = d.withColumns({"plus_dm": p, "minus_dm": m, "plus_di": F.when(seen, 100 * div0(p, t)), "minus_di": F.when(seen, 100 * div0(m, t))})
        a, b = F.col("plus_di"), F.col("minus_di")
        d = d.withColumn("dx", 100 * div0(F.abs(a - b), a + b))
        d = _smooth(d, {"adx": "dx"}, n, ks, order, F.col("_seen"))  # dx has a value wherever n ranges were seen
        d = d.withColumn("adxr", (F.col("adx") + F.lag("adx", n - 1).over(w)) / 2)
        return d.drop("_k", "_ranges", "_seen", *[f"{c}{s}" for c in ("_p", "_m", "_t") for s in ("", "s")])

    return Step(2 * decay_reach(decay) + 3 * n, 0, fn, _counted(order, *counts))


@windowed
def bands(order, n=20, width=2.0):
    """Bollinger (mean and population deviation) and Donchian bands over n rows."""
    def fn(d, ks):
        f = _w(ks, order).rowsBetween(-(n - 1), 0)
        full = _full("close", f, n)
        mid, dev = F.avg("close").over(f), F.stddev_pop("close").over(f)
        hi, lo = F.max("high").over(f), F.min("low").over(f)
        return d.withColumns({k: F.when(full, v) for k, v in {
            "bb_mid": mid, "bb_high": mid + width * dev, "bb_low": mid - width * dev,
            "bb_width": F.try_divide(2 * width * dev, mid) * 100,
            "bb_share": F.try_divide(F.col("close") - (mid - width * dev), 2 * width * dev),
            "dc_high": hi, "dc_low": lo, "dc_mid": (hi + lo) / 2,
        }.items()})

    return Step(n - 1, 0, fn)


def _ema(d, pairs: dict[str, str], n, ks, order):
    """Exponential mean of span n that starts at the key's first value."""
    alpha = 2 / (n + 1)
    w = _w(ks, order)
    entry = lambda c: F.when(F.lag(F.lit(1)).over(w).isNull(), F.col(c)).otherwise(F.col(c) * alpha)
    return decayed_sums(d, {out: entry(c) for out, c in pairs.items()}, 1 - alpha, ks, order)


@windowed
def macd(order, col="close", fast=12, slow=26, signal=9):
    """Fast minus slow exponential mean, its signal line and their difference; non-NULL input."""
    def fn(d, ks):
        d = _ema(d, {"ema_fast": col}, fast, ks, order)
        d = _ema(d, {"ema_slow": col}, slow, ks, order)
        d = d.withColumn("macd", F.col("ema_fast") - F.col("ema_slow"))
        d = _ema(d, {"macd_signal": "macd"}, signal, ks, order)
        return d.withColumn("macd_diff", F.col("macd") - F.col("macd_signal"))

    return Step(sum(decay_reach(1 - 2 / (k + 1)) + 1 for k in (slow, signal)), 0, fn)


@windowed
def atr(order, n=14):
    """Average true range, Wilder smoothing."""
    def fn(d, ks):
        d = d.withColumn("_t", _range(_w(ks, order)))
        return _smooth(d, {"atr": "_t"}, n, ks, order, F.col("_atr_ranges")).drop("_t", "_atr_ranges")

    return Step(decay_reach(1 - 1 / n) + n + 1, 0, fn, _counted(order, {"_atr_ranges": _range}))


def volume_lines(df, keys, order, n=14):
    """On-balance volume, accumulation/distribution and volume price trend (running
    sums), and the n-row volume weighted price."""
    def signed(d, ks):
        w, f = _w(ks, order), _w(ks, order).rowsBetween(-(n - 1), 0)
        prev = F.lag("close").over(w)
        spread = F.col("high") - F.col("low")
        return d.withColumns({
            "_obv": F.when(F.col("close") < prev, -F.col("volume")).otherwise(F.col("volume")),
            "_adi": div0((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), spread) * F.col("volume"),
            "_vpt": F.coalesce(F.col("volume") * F.try_divide(F.col("close") - prev, prev), F.lit(0.0)),
            "vwap": F.when(_full("close", f, n), F.try_divide(F.sum(_typical() * F.col("volume")).over(f), F.sum("volume").over(f))),
        })

    out = by_key(df, keys, order, signed, before=n)
    out = running(out, keys, order, ["_obv", "_adi", "_vpt"], ["sum"], names=lambda c, a: c[1:])
    return out.drop("_obv", "_adi", "_vpt")


def adaptive_mean(df, keys, order, col="close", n=10, fast=2, slow=30, name="kama", split=AUTO):
    """Kaufman's adaptive mean: each row's own weight, from the share of direction in the movement of n rows.

    It starts with the value of the first row that has n rows before it; until then it is NULL.
    """
    weights = 2 / (fast + 1), 2 / (slow + 1)

    def fn(d, ks):
        w = _w(ks, order)
        d = d.withColumn("_move", F.abs(F.col(col) - F.lag(col).over(w)))
        f = w.rowsBetween(-(n - 1), 0)
        way = F.abs(F.col(col) - F.lag(col, n).over(w))
        share = div0(way, F.when(F.count("_move").over(f) == n, F.sum("_move").over(f)))
        weight = F.pow(share * (weights[0] - weights[1]) + weights[1], 2)
        ready = F.lag(F.lit(1), n).over(w).isNotNull()
        first = ready & F.lag(F.lit(1), n + 1).over(w).isNull()
        return d.withColumns({
            "_a": F.when(first, 0.0).when(ready, 1 - weight), "_b": F.when(first, F.col(col)).when(ready, weight * F.col(col))}).drop("_move")

    d = by_key(df, keys, order, fn, before=n + 1, split=split).withColumnsRenamed({"_a": "_kept", "_b": "_given"})
    return affine(d, keys, order, F.col("_kept"), F.col("_given"), name, split).drop("_kept", "_given")


def negative_volume(df, keys, order, start=1000.0, name="nvi", split=AUTO):
    """Negative volume index: grows with the price on rows whose volume is below that of the row before."""
    def fn(d, ks):
        w = _w(ks, order)
        grown = F.try_divide(F.col("close"), F.lag("close").over(w))
        fewer = F.coalesce(F.col("volume") < F.lag("volume").over(w), F.lit(False))
        first = F.lag(F.lit(1)).over(w).isNull()
        return d.withColumns({"_kept": F.when(first, 0.0).when(fewer, grown).otherwise(1.0), "_given": F.when(first, start).otherwise(0.0)})

    d = by_key(df, keys, order, fn, before=1, split=split)
    return affine(d, keys, order, F.col("_kept"), F.col("_given"), name, split).drop("_kept", "_given")


@windowed
def money_flow(order, n=20, span=13, mean=14, scale=100_000_000):
    """Chaikin money flow over n rows, force index (exponential mean of span), ease of movement (times scale) and its mean of rows."""
    def fn(d, ks):
        w, f, g = _w(ks, order), _w(ks, order).rowsBetween(-(n - 1), 0), _w(ks, order).rowsBetween(-(mean - 1), 0)
        spread = F.col("high") - F.col("low")
        d = d.withColumns({
            "_flow": div0((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), spread) * F.col("volume"),
            "_force": (F.col("close") - F.lag("close").over(w)) * F.col("volume"),
            "_fresh": F.lag(F.lit(1), 2).over(w).isNull(),
            "ease": F.try_divide((F.col("high") - F.lag("high").over(w) + F.col("low") - F.lag("low").over(w)) * spread, 2 * F.col("volume")) * scale,
        })
        alpha = 2 / (span + 1)
        entry = F.when(F.col("_fresh"), F.col("_force")).otherwise(F.col("_force") * alpha)
        d = decayed_sums(d, {"force": entry}, 1 - alpha, ks, order)
        return d.withColumns({
            "cmf": F.when(_full("close", f, n), F.try_divide(F.sum("_flow").over(f), F.sum("volume").over(f))),
            "force": F.when(F.lag(F.lit(1), span).over(w).isNotNull(), F.col("force")),
            "ease_mean": F.when(F.count("ease").over(g) == mean, F.avg("ease").over(g)),
        }).drop("_flow", "_force", "_fresh")

    return Step(max(n, mean + 1, decay_reach(1 - 2 / (span + 1)) + span + 1), 0, fn)


def _stop(first, most):
    """Step of the stop-and-reverse machine; its state is (rows seen, stop, extreme of the trend, speed, rising)."""
    def step(state, values):
        high, low, close, high1, low1, high2, low2 = values
        if high is None or low is None or close is None:
            return state, (None, None)
        if state is None:
            return (1, close, high, first, True), (None, None)
        seen, stop, extreme, speed, rising = state
        if seen < 2:
            return (2, close, extreme, speed, rising), (None, None)
        stop += speed * (extreme - stop)
        reach, risk, side = (high, low, 1) if rising else (low, high, -1)
        if (stop - risk) * side > 0:  # crossed: the old extreme is the new stop, on the other side
            stop, extreme, speed, rising = extreme, risk, first, not rising
        else:
            if (reach - extreme) * side > 0:
                extreme, speed = reach, min(speed + first, most)
            for before in (low2, low1) if rising else (high2, high1):
                if before is not None and (stop - before) * side > 0:  # never inside the two rows before
                    stop = before
                    break
        return (seen + 1, stop, extreme, speed, rising), ((stop, None) if rising else (None, stop))

    return step


def stop_and_reverse(df, keys, order, first=0.02, most=0.2, split=AUTO):
    """Parabolic stop and reverse: psar_up while the trend rises, psar_down while it falls; NULL on a key's first two rows."""
    def fn(d, ks):
        w = _w(ks, order)
        return d.withColumns({f"_{c}{i}": F.lag(c, i).over(w) for c in ("high", "low") for i in (1, 2)})

    d = by_key(df, keys, order, fn, before=2, split=split)
    cols = ["high", "low", "close", "_high1", "_low1", "_high2", "_low2"]
    state = "seen bigint, stop double, extreme double, speed double, rising boolean"
    out = machine(d, keys, order, cols, _stop(first, most), state, "psar_up double, psar_down double", split)
    return out.drop("_high1", "_low1", "_high2", "_low2")
