"""Ordered work per key that holds when one key owns a large share of the rows.

A window partitioned by a key sorts that whole key in one task. That is the best
plan while keys are small, so it stays the default. Before it is used, a narrow
scan draws about one row in ``SEGMENT_ROWS`` by a hash of key and order. Keys drawn
at least twice are large: their drawn rows become *splitters*, cutting the key
into segments that are windowed in parallel.

* Frames of limited reach (lags, rolling) see copies of the neighbouring rows.
* Running frames get the state of the earlier segments, which is a small table of
  one row per segment.

Any set of splitters gives the same result; they steer balance only. Every operator
takes ``split``: ``AUTO`` draws them, ``None`` states that no key can be large (say,
one row per month), and splitters drawn before, even from a table this one was made
from, can be passed on, so a chain of operators reads its input once for them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import stored

SEG, CTX, POS = "_seg", "_ctx", "_at_row"
SEGMENT_ROWS = 2_000_000
MAX_SPLITTERS = 100_000
AUTO = "auto"


def segment_rows(df: DataFrame) -> int:
    """Rows a segment should hold; ``panelforge.segmentRows`` overrides it."""
    return int(df.sparkSession.conf.get("panelforge.segmentRows", str(SEGMENT_ROWS)))


def listed(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def point(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(order)])


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys where NULL equals NULL, keeping one copy of the keys."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def attach(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table, as a scalar subquery; more rows are an error at run time."""
    held = row.select(F.struct(*row.columns).alias("_row")).scalar()
    return df.withColumn("_row", held).select(*df.columns, "_row.*")


@dataclass
class Splitters:
    table: DataFrame  # keys, _pts: sorted array of points; at most MAX_SPLITTERS points in all
    steps: int  # binary search steps that cover the longest array


def splitters(df: DataFrame, keys, order) -> Splitters | None:
    """Splitters of the large keys, or None if no key is large.

    The sample is bounded: past ``MAX_SPLITTERS`` rows it is thinned and redrawn.
    """
    keys, order = listed(keys), listed(order)
    rows = max(2, segment_rows(df))
    hashed = F.xxhash64(*[F.col(c) for c in keys + order])
    narrow = df.select(*[F.col(k) for k in keys], point(order).alias("_pt"), hashed.alias("_h"))
    while True:
        drawn = narrow.filter(F.pmod("_h", F.lit(rows)) == 0).limit(MAX_SPLITTERS + 1).collect()
        if len(drawn) <= MAX_SPLITTERS:
            break
        rows *= 8
    by_key: dict[tuple, set] = {}
    for r in drawn:
        by_key.setdefault(tuple(r[k] for k in keys), set()).add(tuple(r["_pt"]))
    large = [(*k, sorted(p)) for k, p in by_key.items() if len(p) >= 2]
    if not large:
        return None
    schema = T.StructType(
        [df.schema[k] for k in keys] + [T.StructField("_pts", T.ArrayType(narrow.schema["_pt"].dataType))]
    )
    steps = math.ceil(math.log2(max(len(r[-1]) for r in large) + 1)) + 1
    return Splitters(df.sparkSession.createDataFrame(large, schema), steps)


def _chosen(df, keys, order, split) -> Splitters | None:
    return splitters(df, keys, order) if split == AUTO else split


def _located(df: DataFrame, keys: list[str], order: list[str], sp: Splitters) -> DataFrame:
    """Rows of the large keys with their segment: the number of splitters at or before the row."""
    pts, at = F.col("_pts"), F.col("_pt")

    def narrow(a, _):
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        up = F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))
        down = F.struct(a["lo"].alias("lo"), mid.alias("hi"))
        return F.when(a["lo"] >= a["hi"], a).when(pts[mid] <= at, up).otherwise(down)

    start = F.struct(F.lit(0).alias("lo"), F.size(pts).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(sp.steps)), start, narrow, lambda a: a["lo"])
    hot = same_keys(df, F.broadcast(sp.table), keys, "inner").withColumn("_pt", point(order))
    return hot.withColumn(SEG, found.cast("int")).drop("_pts", "_pt")


def _cold(df: DataFrame, keys: list[str], sp: Splitters) -> DataFrame:
    return same_keys(df, F.broadcast(sp.table.select(*keys)), keys, "left_anti")


def _carried(hot: DataFrame, keys: list[str], local: dict[str, Column], merge: Callable, back: bool = False) -> DataFrame:
    """Add to each row what the segments before (after, if ``back``) its own leave behind.

    ``local`` are aggregates per segment; ``merge(w)`` gives the columns to add,
    over the window ``w`` of the other segments. One row per segment: small.
    """
    per = hot.groupBy(*keys, SEG).agg(*[c.alias(n) for n, c in local.items()])
    w = W.partitionBy(*keys).orderBy(SEG)
    w = w.rowsBetween(1, W.unboundedFollowing) if back else w.rowsBetween(W.unboundedPreceding, -1)
    states = per.select(*keys, SEG, *[c.alias(n) for n, c in merge(w).items()])
    return same_keys(hot, F.broadcast(states), keys + [SEG], "inner")


def _positioned(hot: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    based = _carried(hot, keys, {"_n": F.count(F.lit(1))}, lambda w: {"_base": F.coalesce(F.sum("_n").over(w), F.lit(0))})
    rn = F.row_number().over(W.partitionBy(*keys, SEG).orderBy(*order))
    return based.withColumn(POS, F.col("_base") + rn).drop("_base")


def by_key(df: DataFrame, keys, order, fn: Callable, before: int = 0, after: int = 0, split=AUTO) -> DataFrame:
    """Run ``fn(df, keys)``, made of windows over ``keys`` that look at most
    ``before`` rows back and ``after`` rows ahead."""
    keys, order = listed(keys), listed(order)
    sp = _chosen(df, keys, order, split)
    if sp is None:
        return fn(df, keys)
    block = max(segment_rows(df), before + after + 1)
    at = F.col(POS) - 1
    first = F.floor(F.greatest(at - after, F.lit(0)) / block)
    last = F.floor((at + before) / block)
    seen = _positioned(_located(df, keys, order, sp), keys, order)
    seen = (
        seen.withColumn("_home", F.floor(at / block))
        .withColumn(SEG, F.explode(F.sequence(first, last)))
        .withColumn(CTX, F.col(SEG) != F.col("_home"))
        .drop("_home", POS)
    )
    hot = fn(seen, keys + [SEG]).filter(~F.col(CTX)).drop(SEG, CTX)
    return fn(_cold(df, keys, sp), keys).unionByName(hot)


def positions(df: DataFrame, keys, order, name: str = "pos", split=AUTO) -> DataFrame:
    """1-based row number within the key."""
    keys, order = listed(keys), listed(order)
    plain = F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")
    sp = _chosen(df, keys, order, split)
    if sp is None:
        return df.withColumn(name, plain)
    hot = _positioned(_located(df, keys, order, sp), keys, order)
    hot = hot.withColumn(name, F.col(POS)).drop(SEG, POS)
    return _cold(df, keys, sp).withColumn(name, plain).unionByName(hot)


def running(df: DataFrame, keys, order, cols, aggs, exclude_current: bool = False, split=AUTO,
            names: Callable | None = None) -> DataFrame:
    """Running count, sum, avg, min, max, std_samp, std_pop over all rows so far.

    NULL values are skipped. ``exclude_current`` leaves the present row out.
    """
    keys, order, cols, aggs = listed(keys), listed(order), listed(cols), listed(aggs)
    names = names or (lambda c, a: f"{c}_running_{a}")
    hi = -1 if exclude_current else W.currentRow
    direct = {
        "count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
        "std_samp": F.stddev_samp, "std_pop": F.stddev_pop,
    }

    def frame(ks):
        return W.partitionBy(*ks).orderBy(*order).rowsBetween(W.unboundedPreceding, hi)

    def plain(d):
        w = frame(keys)
        return d.withColumns({names(c, a): direct[a](c).over(w) for c in cols for a in aggs})

    sp = _chosen(df, keys, order, split)
    if sp is None:
        return plain(df)
    hot = _located(df, keys, order, sp)
    w = frame(keys + [SEG])
    local, added = {}, []
    # only the state that the asked aggregates need: dates have a maximum but no sum
    asked = set(aggs)
    moments, sums, ends = asked & {"std_samp", "std_pop"}, asked & {"sum", "avg"}, asked & {"min", "max"}
    for c in cols:
        local[f"{c}_n"] = F.count(c)
        if sums:
            local[f"{c}_s"] = F.sum(c)
        if ends:
            local |= {f"{c}_lo": F.min(c), f"{c}_hi": F.max(c)}
        if moments:
            local |= {f"{c}_m": F.avg(c).cast("double"), f"{c}_q": F.var_pop(c) * F.count(c)}

    def merge(v):
        out = {}
        for c in cols:
            n = F.col(f"{c}_n")
            total = F.sum(n).over(v)
            out[f"_{c}_n"] = F.coalesce(total, F.lit(0))
            if sums:
                out[f"_{c}_s"] = F.sum(f"{c}_s").over(v)
            if ends:
                out |= {f"_{c}_lo": F.min(f"{c}_lo").over(v), f"_{c}_hi": F.max(f"{c}_hi").over(v)}
            if moments:
                m, q = F.col(f"{c}_m"), F.col(f"{c}_q")
                centre = F.avg(m).over(W.partitionBy(*keys))
                mean = F.sum(n * m).over(v) / total
                spread = F.sum(q + n * F.pow(m - centre, 2)).over(v) - total * F.pow(mean - centre, 2)
                out |= {f"_{c}_m": mean, f"_{c}_q": spread}
        added.extend(out)
        return out

    hot = _carried(hot, keys, local, merge)
    kinds = plain(df.select(*keys, *order, *[c for c in cols if c not in keys + order])).schema
    got = {}
    for c in cols:
        n0, n1 = F.col(f"_{c}_n"), F.count(c).over(w)
        n = n0 + n1
        have = {"count": n}
        if sums:
            s1, s0 = F.sum(c).over(w), F.col(f"_{c}_s")
            total = F.when(s0.isNull(), s1).when(s1.isNull(), s0).otherwise(s0 + s1)
            have |= {"sum": total, "avg": F.when(n > 0, total / n)}
        if ends:
            have |= {"min": F.least(F.col(f"_{c}_lo"), F.min(c).over(w)), "max": F.greatest(F.col(f"_{c}_hi"), F.max(c).over(w))}
        if moments:
            m0, q0 = F.coalesce(f"_{c}_m", F.lit(0.0)), F.coalesce(f"_{c}_q", F.lit(0.0))
            m1 = F.coalesce(F.avg(c).over(w).cast("double"), F.lit(0.0))
            q1 = F.coalesce(F.var_pop(c).over(w), F.lit(0.0)) * n1
            spread = q0 + q1 + F.when((n0 > 0) & (n1 > 0), F.pow(m1 - m0, 2) * n0 * n1 / n).otherwise(0.0)
            have |= {
                "std_samp": F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1))),
                "std_pop": F.when(n > 0, F.sqrt(F.greatest(spread, F.lit(0.0)) / n)),
            }
        # the types of the plain window, whatever the size of the key
        got |= {names(c, a): have[a].cast(kinds[names(c, a)].dataType) for a in aggs}
    hot = hot.withColumns(got).drop(SEG, *added)
    return plain(_cold(df, keys, sp)).unionByName(hot)


def fill(df: DataFrame, keys, order, cols, back: bool = False, split=AUTO) -> DataFrame:
    """Replace NULL by the last earlier (``back``: next later) value of the key."""
    keys, order, cols = listed(keys), listed(order), listed(cols)

    def plain(d, ks):
        w = W.partitionBy(*ks).orderBy(*order)
        if back:
            w = w.rowsBetween(0, W.unboundedFollowing)
            return d.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in cols})
        w = w.rowsBetween(W.unboundedPreceding, 0)
        return d.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})

    sp = _chosen(df, keys, order, split)
    if sp is None:
        return plain(df, keys)
    edge = F.min_by if back else F.max_by
    over = F.first if back else F.last
    local = {f"{c}_e": edge(F.col(c), F.when(F.col(c).isNotNull(), point(order))) for c in cols}
    hot = _carried(
        _located(df, keys, order, sp), keys, local,
        lambda w: {f"_{c}_e": over(f"{c}_e", ignorenulls=True).over(w) for c in cols}, back,
    )
    hot = plain(hot, keys + [SEG]).withColumns({c: F.coalesce(c, f"_{c}_e") for c in cols})
    return plain(_cold(df, keys, sp), keys).unionByName(hot.drop(SEG, *[f"_{c}_e" for c in cols]))


def running_all(df: DataFrame, order, cols, aggs, exclude_current: bool = False, names=None) -> DataFrame:
    """``running`` over the whole table in one order, without a one-task window on large input."""
    return running(df.withColumn("_all", F.lit(0)), "_all", order, cols, aggs, exclude_current, names=names).drop("_all")


def positions_all(df: DataFrame, order, name: str = "pos") -> DataFrame:
    """1-based position of each row in the order of the whole table."""
    return positions(df.withColumn("_all", F.lit(0)), "_all", order, name).drop("_all")


def group_quantiles(df: DataFrame, keys, col: str, qs, how: str = "linear", names: Callable | None = None) -> DataFrame:
    """Exact quantiles per key, one row per key; NULL values are skipped.

    Equal values are counted before the shuffle and large keys are cut by value,
    so no task holds all values of a key. ``how``: linear, nearest (half to even).
    """
    keys, qs = listed(keys), list(qs)
    names = names or (lambda q: f"{col}_q{q}")
    counted = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
    totals = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = running(counted, keys, [col], ["_c"], ["sum"], names=lambda c, a: "_cum")
    ranked = same_keys(ranked, totals, keys, "inner")
    picked, final = [], []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = (F.bround(at), F.bround(at)) if how == "nearest" else (F.floor(at), F.ceil(at))
        for side, index in (("lo", low), ("hi", high)):
            here = (F.col("_cum") > index) & (F.col("_cum") - F.col("_c") <= index)
            picked.append(F.max(F.when(here, F.col(col))).alias(f"_{side}{i}"))
        picked.append(F.max(at - F.floor(at)).alias(f"_f{i}"))
        lo, hi, f = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_f{i}")
        final.append((lo if how == "nearest" else lo + (hi - lo) * f).alias(names(q)))
    return ranked.groupBy(*keys).agg(*picked).select(*keys, *final)


@dataclass
class Step:
    """Window columns with their reach in rows.

    ``prepare(df, keys, split)`` adds columns that look at all earlier rows (running counts, say) before the
    step runs; ``finish(df, keys, split)`` works on its result in the same way.
    """

    before: int
    after: int
    fn: Callable[[DataFrame, list[str]], DataFrame]
    prepare: Callable | None = None
    finish: Callable | None = None


def chain(df: DataFrame, keys, order, *steps: Step, split=AUTO) -> DataFrame:
    """Apply several steps over one key and order: one shuffle, one sort."""
    keys, order = listed(keys), listed(order)
    if any(s.prepare or s.finish for s in steps):
        split = _chosen(df, keys, order, split)
    for s in steps:
        df = s.prepare(df, keys, split) if s.prepare else df

    def fn(d, ks):
        for s in steps:
            d = s.fn(d, ks)
        return d

    out = by_key(df, keys, order, fn, sum(s.before for s in steps), sum(s.after for s in steps), split)
    for s in steps:
        out = s.finish(held(out, split), keys, split) if s.finish else out
    return out


def held(df: DataFrame, split) -> DataFrame:
    """``df``, stored first if large keys are cut: what follows then reads it once for the cut keys, once for the
    others and once for the segments' states, and must not compute it each time."""
    return df if split is None else stored(df)


def windowed(factory: Callable[..., Step]):
    """Turn ``factory(order, ...) -> Step`` into an operator ``op(df, keys, order, ...)``;
    ``op.step`` is the factory, for use in ``chain``."""

    @functools.wraps(factory)
    def op(df, keys, order, *args, split=AUTO, **kw):
        return chain(df, keys, order, factory(listed(order), *args, **kw), split=split)

    op.step = factory
    return op
