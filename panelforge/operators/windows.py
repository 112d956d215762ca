"""Window features per key and order.

Every operator is ``op(df, keys, order, ...)``; ``op.step(order, ...)`` gives the
same columns for ``ordered.chain``, which serves many with one sort. ``order``
must end in a unique column. Windows reach a fixed number of rows unless stated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window as W, functions as F

from .ordered import AUTO, Step, attach, chain, fill, listed, positions, running, same_keys, splitters, windowed
from ..functions.scalars import clip, correlation, frac_part, int_part


def _w(ks, order):
    return W.partitionBy(*ks).orderBy(*order)


@windowed
def lags(order, cols, ns, names=None):
    """Value n rows earlier; a negative n looks ahead."""
    cols, ns = listed(cols), list(ns)
    names = names or (lambda c, n: f"{c}_lag_{n}")
    fn = lambda d, ks: d.withColumns({names(c, n): F.lag(c, n).over(_w(ks, order)) for c in cols for n in ns})
    return Step(max([0, *ns]), max([0, *[-n for n in ns]]), fn)


@windowed
def diffs(order, cols, ns, shift=0, names=None):
    """Value minus the value n rows earlier (later for n < 0), both ``shift`` rows back."""
    cols, ns = listed(cols), list(ns)
    names = names or (lambda c, n: f"{c}_diff_{n}")

    def one(c, n, w):
        now = F.lag(c, shift).over(w) if shift else F.col(c)
        return now - F.lag(c, n + shift).over(w)

    fn = lambda d, ks: d.withColumns({names(c, n): one(c, n, _w(ks, order)) for c in cols for n in ns})
    return Step(max([0, *ns]) + shift, max([0, *[-n for n in ns]]), fn)


@windowed
def pct_changes(order, cols, ns, lo=None, hi=None, shift=0, names=None):
    """Relative change to n rows earlier, clipped; NULL when the base is 0."""
    cols, ns = listed(cols), list(ns)
    names = names or (lambda c, n: f"{c}_pct_{n}")

    def one(c, n, w):
        now = F.lag(c, shift).over(w) if shift else F.col(c)
        return clip(F.try_divide(now, F.lag(c, n + shift).over(w)) - 1, lo, hi)

    fn = lambda d, ks: d.withColumns({names(c, n): one(c, n, _w(ks, order)) for c in cols for n in ns})
    return Step(max(ns) + shift, max([0, *[-n for n in ns]]), fn)


@windowed
def change_ratio(order, col, name=None):
    """Absolute relative change to the previous row: 0/0 is 0, x/0 is 1."""
    def fn(d, ks):
        prev, now = F.lag(col).over(_w(ks, order)), F.col(col)
        ratio = F.when((prev == 0) & (now == 0), 0.0).when(prev == 0, 1.0).otherwise(F.abs(F.try_divide(now, prev) - 1))
        return d.withColumn(name or f"{col}_change", ratio)

    return Step(1, 0, fn)


def _corrected(kind: str, x: Column, n: Column) -> Column:
    """Sample (bias-corrected) skewness or excess kurtosis from the population form."""
    if kind == "skew":
        return F.when(n >= 3, x * F.sqrt(n * (n - 1)) / (n - 2))
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * x + 6))


@windowed
def rolling(order, col, wins, aggs=("avg",), shift=0, min_periods=None, center=False, forward=False, names=None):
    """Statistics of a moving window of ``w`` rows ending ``shift`` rows back.

    ``min_periods`` values must be present, ``w`` if not given. ``center`` puts the
    row in the middle of an odd window, ``forward`` at its start. Aggregates: avg,
    sum, std, var, min, max, median, count, skew, kurt, nunique.
    """
    wins, aggs = list(wins), listed(aggs)
    names = names or (lambda a, w: f"{col}_{a}_{w}")
    c = F.col(col)

    def bounds(w):
        if center:
            return -(w // 2), (w - 1) // 2
        return (shift, shift + w - 1) if forward else (-(shift + w - 1), -shift)

    def one(a, w, ks):
        f = _w(ks, order).rowsBetween(*bounds(w))
        n = F.count(c).over(f)
        simple = {
            "avg": F.avg, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max,
            "count": F.count, "median": lambda x: F.percentile(x, 0.5),
        }
        if a in simple:
            x = simple[a](c).over(f)
        elif a == "nunique":
            x = F.size(F.collect_set(c).over(f))
        else:
            x = _corrected(a, (F.skewness if a == "skew" else F.kurtosis)(c).over(f), n)
        return F.when(n >= (w if min_periods is None else min_periods), x)

    fn = lambda d, ks: d.withColumns({names(a, w): one(a, w, ks) for w in wins for a in aggs})
    lo, hi = [bounds(w)[0] for w in wins], [bounds(w)[1] for w in wins]
    return Step(max(0, -min(lo)), max(0, max(hi)), fn)


@windowed
def rolling_rate(order, pred, wins, shift=0, names=None):
    """Share and count of rows that meet ``pred`` in a full moving window."""
    names = names or (lambda a, w: f"{a}_{w}")
    hit = pred.cast("int")

    def fn(d, ks):
        out = {}
        for w in wins:
            f = _w(ks, order).rowsBetween(-(shift + w - 1), -shift)
            full = F.count(F.lit(1)).over(f) == w
            out[names("rate", w)] = F.when(full, F.avg(F.coalesce(hit, F.lit(0))).over(f))
            out[names("count", w)] = F.when(full, F.sum(F.coalesce(hit, F.lit(0))).over(f))
        return d.withColumns(out)

    return Step(max(wins) + shift, 0, fn)


@windowed
def rolling_slope(order, col, win=12, min_periods=9):
    """Slope, correlation and its square of the value against the row position."""
    def fn(d, ks):
        d = d.withColumn("_i", F.row_number().over(_w(ks, order)).cast("double"))
        f = _w(ks, order).rowsBetween(-(win - 1), 0)
        enough = F.count(col).over(f) >= min_periods
        d = d.withColumns({
            f"{col}_slope_{win}": F.when(enough, F.regr_slope(F.col(col), F.col("_i")).over(f)),
            f"{col}_corr_{win}": F.when(enough, correlation(col, "_i", f)),
        }).drop("_i")
        return d.withColumn(f"{col}_r2_{win}", F.col(f"{col}_corr_{win}") * F.col(f"{col}_corr_{win}"))

    return Step(win - 1, 0, fn)


def memory(decay: float) -> int:
    """Rows after which a weight of ``decay`` per row is below double precision."""
    return max(1, math.ceil(54 * math.log(2) / -math.log(decay)))


def decay_block(decay: float) -> int:
    """Rows of a block: twelve times ``memory``, so a weight inside it is 2 ** -648 at least."""
    return 12 * memory(decay)


def decay_reach(decay: float) -> int:
    """Rows that ``decayed_sums`` looks back: weights beyond two blocks are 0 in double precision."""
    return 3 * decay_block(decay)


def decayed_sums(d, exprs: dict[str, Column], decay, ks, order):
    """Add sums of value x decay^age over the rows so far, one column per expression.

    Rows are cut into blocks. A running sum inside the block plus the totals of the two blocks before is the
    whole sum, also after long runs of 0 or NULL: what is older has a weight below 2 ** -1290, which a double
    holds as 0. Constant work per row; NULL counts as 0. Values above 1e110 overflow.
    """
    size = decay_block(decay)
    up, down = (lambda e: F.pow(F.lit(1 / decay), e)), (lambda e: F.pow(F.lit(decay), e))
    d = d.withColumns({f"_x_{n}": F.coalesce(e.cast("double"), F.lit(0.0)) for n, e in exprs.items()})
    d = d.withColumn("_rn", F.row_number().over(_w(ks, order)) - 1)
    d = d.withColumns({"_blk": F.floor(F.col("_rn") / size), "_off": F.col("_rn") % size})
    inside = W.partitionBy(*ks, "_blk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    off = F.col("_off")

    def total(x):
        now = F.sum(x * up(off)).over(inside) * down(off)
        for back in (1, 2):
            before = F.sum(x * down(size - 1 - off)).over(W.partitionBy(*ks).orderBy("_blk").rangeBetween(-back, -back))
            now = now + F.coalesce(before, F.lit(0.0)) * down(off + 1 + (back - 1) * size)
        return now

    d = d.withColumns({n: total(F.col(f"_x_{n}")) for n in exprs})
    return d.drop("_rn", "_blk", "_off", *[f"_x_{n}" for n in exprs])


@windowed
def ewm(order, col, alpha, shift=0, name=None):
    """Adjusted exponentially weighted mean; NULL values keep their age but weigh nothing.

    At a NULL the mean is that of the last value before it, however far back.
    """
    name = name or f"{col}_ewm"

    def fn(d, ks):
        d = d.withColumn("_s", F.lag(col, shift).over(_w(ks, order)) if shift else F.col(col))
        d = decayed_sums(d, {"_v": F.col("_s"), "_n": F.col("_s").isNotNull().cast("double")}, 1 - alpha, ks, order)
        return d.withColumn(name, F.when(F.col("_s").isNotNull(), F.col("_v") / F.col("_n"))).drop("_s", "_v", "_n")

    return Step(decay_reach(1 - alpha) + shift + 1, 0, fn, finish=lambda d, keys, split: fill(d, keys, order, [name], split=split))


@windowed
def impute_centered(order, col, win=3, name=None):
    """Value, else the mean of the full centred window, else 0; with a flag of the missing."""
    def fn(d, ks):
        f = _w(ks, order).rowsBetween(-(win // 2), win // 2)
        others = F.count(F.lit(1)).over(f) == win
        mean = F.when(others & (F.count(col).over(f) == win - 1), F.avg(col).over(f))
        return d.withColumns({
            f"{col}_missing": F.col(col).isNull().cast("int"),
            name or f"{col}_imputed": F.coalesce(F.col(col), mean, F.lit(0.0)),
        })

    return Step(win // 2, win // 2, fn)


@windowed
def past_gaps(order, col, n=5):
    """The i-th most recent gap between earlier rows, i from 0; the present row is left out."""
    def fn(d, ks):
        w = _w(ks, order)
        return d.withColumns({f"{col}_gap_{i}": F.lag(col, i + 1).over(w) - F.lag(col, i + 2).over(w) for i in range(n)})

    return Step(n + 1, 0, fn)


@windowed
def recent_past(order, cols, ns):
    """Mean and population deviation of the last n earlier rows; NULL unless more than n exist."""
    cols = listed(cols)

    def fn(d, ks):
        out = {}
        for n in ns:
            f = _w(ks, order).rowsBetween(-n, -1)
            longer = F.lag(F.lit(1), n + 1).over(_w(ks, order)).isNotNull()
            for c in cols:
                out[f"{c}_avg_last_{n}"] = F.when(longer, F.avg(c).over(f))
                out[f"{c}_std_last_{n}"] = F.when(longer, F.stddev_pop(c).over(f))
        return d.withColumns(out)

    return Step(max(ns) + 1, 0, fn)


@windowed
def log_return(order, col, n=1, absolute=False, name=None):
    """log(x) minus log(x n rows earlier)."""
    def fn(d, ks):
        r = F.log(F.col(col)) - F.log(F.lag(col, n).over(_w(ks, order)))
        return d.withColumn(name or f"{col}_logret_{n}", F.abs(r) if absolute else r)

    return Step(n, 0, fn)


@windowed
def supervised(order, cols, n):
    """Each row with all given columns of the n rows before it; rows lacking any are dropped."""
    cols = listed(cols)
    names = [f"{c}_t_{i}" for i in range(n, 0, -1) for c in cols]

    def fn(d, ks):
        w = _w(ks, order)
        d = d.withColumns({f"{c}_t_{i}": F.lag(c, i).over(w) for i in range(n, 0, -1) for c in cols})
        return d.dropna(subset=names + cols)

    return Step(n, 0, fn)


@windowed
def window_pairs(order, col, n):
    """The n earlier values as an array beside the present value; full windows only."""
    def fn(d, ks):
        f = _w(ks, order).rowsBetween(-n, -1)
        d = d.withColumn("window", F.collect_list(col).over(f)).withColumn("next_value", F.col(col))
        return d.filter(F.size("window") == n)

    return Step(n, 0, fn)


@windowed
def rolling_apply(order, col, win, fn, name, min_periods=None):
    """``fn(array of the window)`` as a column expression over the last ``win`` values."""
    def run(d, ks):
        values = F.collect_list(col).over(_w(ks, order).rowsBetween(-(win - 1), 0))
        d = d.withColumn("_a", values)
        return d.withColumn(name, F.when(F.size("_a") >= (min_periods or win), fn(F.col("_a")))).drop("_a")

    return Step(win - 1, 0, run)


@windowed
def price_relatives(order, price):
    """Relative price to the previous row, and its whole and fractional parts."""
    def fn(d, ks):
        prev = F.lag(price).over(_w(ks, order))
        return d.withColumns({
            f"{price}_to_prev": F.try_divide(F.col(price), prev),
            f"{price}_whole": int_part(price), f"{price}_frac": frac_part(price),
        })

    return Step(1, 0, fn)


# running and whole-group features


def transform_agg(df, keys, aggs: dict[str, Column]):
    """Aggregates per key beside each row: partial aggregation and a join, so a large key is never one task.

    Both sides go by one struct of the keys, which is never NULL and equal where its NULL fields agree: the
    aggregates are joined where they were made, without another shuffle.
    """
    held = df.withColumn("_key", F.struct(*listed(keys)))
    per = held.groupBy("_key").agg(*[c.alias(n) for n, c in aggs.items()]).withColumnRenamed("_key", "_of")
    return held.join(per, F.col("_key") == F.col("_of"), "left").drop("_key", "_of")


def cumcount(df, keys, order, mod=None, name="cumcount", split=AUTO):
    """Rows before this one in the key, optionally modulo ``mod``."""
    out = positions(df, keys, order, name, split)
    return out.withColumn(name, F.col(name) - 1 if mod is None else (F.col(name) - 1) % mod)


def ffill(df, keys, order, cols, split=AUTO):
    return fill(df, keys, order, cols, split=split)


def bfill(df, keys, order, cols, split=AUTO):
    return fill(df, keys, order, cols, back=True, split=split)


def since_last(df, keys, order, step, pred, shift=0, name="since_last", split=AUTO):
    """Distance in ``step`` units to the last row meeting ``pred`` at least ``shift`` rows back."""
    split = splitters(df, keys, order) if split == AUTO else split
    marked = df.withColumn("_hit", F.when(pred, F.col(step)))
    marked = fill(marked, keys, order, "_hit", split=split)
    if shift:
        marked = lags(marked, keys, order, "_hit", [shift], names=lambda c, n: c, split=split)
    return marked.withColumn(name, F.col(step) - F.col("_hit")).drop("_hit")


def weeks_since_first(df, keys, week, name="weeks_since_first"):
    """Weeks since the first row of the key."""
    out = transform_agg(df, keys, {"_first": F.min(week)})
    return out.withColumn(name, F.col(week) - F.col("_first")).drop("_first")


def decay_weight(df, step, keep, rate=0.0005, name="weight"):
    """1 for the last ``keep`` steps, then ``rate`` less per step."""
    last = df.agg(F.max(step).alias("_last"))  # one row
    back = F.col("_last") - F.col(step)
    weight = F.when(back < keep, 1.0).otherwise(1.0 - rate * (back - keep + 1))
    return df.transform(attach, last).withColumn(name, weight).drop("_last")


def weeks_before_latest(df, ts, name="week"):
    """Whole weeks before the latest day, from 1, and that number over its maximum."""
    ends = df.agg(F.max(F.to_date(ts)).alias("_hi"), F.min(F.to_date(ts)).alias("_lo"))
    week = lambda d: F.floor(F.datediff("_hi", d) / 7) + 1
    out = df.transform(attach, ends)
    return out.withColumn(name, week(F.to_date(ts))).withColumn(f"{name}_scaled", F.col(name) / week("_lo")).drop("_hi", "_lo")


def visit_index(df, keys, ts, cap=None, name="visit"):
    """Rank of the day among the days the key was active, from 1, capped."""
    keys = listed(keys)
    days = df.groupBy(*keys, F.to_date(ts).alias("_day")).agg(F.lit(1).alias("_one"))
    days = positions(days, keys, ["_day"], name).drop("_one")
    out = same_keys(df.withColumn("_day", F.to_date(ts)), days, keys + ["_day"], "left").drop("_day")
    return out if cap is None else out.withColumn(name, F.least(F.col(name), F.lit(cap)))


def rank_avg(df, keys, col, name="rank"):
    """Rank by value within the key, from 1; equal values share the mean rank."""
    keys = listed(keys)
    counted = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counted, keys, [col], ["_c"], ["sum"], names=lambda c, a: "_cum")
    ranked = ranked.select(*keys, col, (F.col("_cum") - (F.col("_c") - 1) / 2).alias(name))
    return same_keys(df, ranked, keys + [col], "left")


def rolling_share_weight(df, key, step, value, scale_col, win, name="weight"):
    """Rolling sum of the value as a share of all keys' at the same step, times the
    key's scale, brought to 0..1 per step."""
    rolled = rolling(df, key, step, value, [win], ["sum"], names=lambda a, w: "_sum")
    out = transform_agg(rolled, step, {"_all": F.sum("_sum")})
    out = out.withColumn("_w", F.try_divide(F.col("_sum"), F.col("_all")) * F.col(scale_col))
    out = transform_agg(out, step, {"_lo": F.min("_w"), "_hi": F.max("_w")})
    scaled = F.try_divide(F.col("_w") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return out.withColumn(name, scaled).drop("_sum", "_all", "_w", "_lo", "_hi")


@windowed
def rolling_scale(order, col, win=90, least=28, name="scale"):
    """Mean squared step between known values from the first one that is not 0 in the window of ``win`` rows.

    0 if the window has fewer than ``least`` known values, or no two values to step between; a window of 0s has
    steps of 0. Constant work per row: running sums of squared steps, read at the row and at the first non-zero
    row at or after the window's start.
    """
    def fn(d, ks):
        w = _w(ks, order)
        past = w.rowsBetween(W.unboundedPreceding, 0)
        ahead = w.rowsBetween(0, W.unboundedFollowing)
        x = F.col(col).cast("double")
        d = d.withColumn("_prev", F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
        d = d.withColumn("_sq", F.pow(x - F.col("_prev"), 2))
        d = d.withColumns({"_sum": F.coalesce(F.sum("_sq").over(past), F.lit(0.0)), "_cnt": F.count("_sq").over(past), "_known": F.count(x).over(past), "_rn": F.row_number().over(w)})
        mark = F.when(x != 0, F.struct("_rn", "_sum", "_cnt"))
        d = d.withColumn("_next", F.first(mark, ignorenulls=True).over(ahead))
        # the window starts win - 1 rows back, or at the first row there is
        d = d.withColumns({
            "_at": F.when(F.col("_rn") >= win, F.lag("_next", win - 1).over(w)).otherwise(F.first("_next").over(past)),
            "_in": F.col("_known") - F.coalesce(F.lag("_known", win).over(w), F.lit(0)),
        })
        live = F.col("_at._rn") <= F.col("_rn")
        steps = F.col("_cnt") - F.col("_at._cnt")
        mean = F.when(live & (steps > 0), (F.col("_sum") - F.col("_at._sum")) / steps)
        scale = F.when(F.col("_in") >= least, F.greatest(F.coalesce(mean, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
        return d.withColumn(name, scale).drop("_prev", "_sq", "_sum", "_cnt", "_known", "_rn", "_next", "_at", "_in")

    return Step(2 * win, win, fn)


def sample_weight(df, key, step, value, amount, win=28, shift=28, scale_win=90, least=28, name="weight"):
    """Weight of a row by its key's share of recent amounts, less where the value is erratic, from 0 to 1 over the table.

    The share is that of the key in the sum of ``amount`` over ``win`` rows, ``shift`` rows back, among all keys of the
    step, 0 if not full; it is divided by 1 + the root of ``rolling_scale`` of ``value``.
    """
    keys, order = listed(key), listed(step)
    sums = rolling.step(order, amount, [win], ["sum"], shift=shift, names=lambda a, w: "_recent")
    both = chain(df, keys, order, sums, rolling_scale.step(order, value, scale_win, least, "_scale"))
    out = transform_agg(both, step, {"_all": F.sum("_recent")})
    share = F.coalesce(F.try_divide(F.col("_recent"), F.col("_all")), F.lit(0.0))
    out = out.withColumn("_weight", share / (F.sqrt("_scale") + 1))
    ends = out.agg(F.min("_weight").alias("_lo"), F.max("_weight").alias("_hi"))
    out = attach(out, ends)
    return out.withColumn(name, F.try_divide(F.col("_weight") - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_recent", "_all", "_weight", "_scale", "_lo", "_hi")
