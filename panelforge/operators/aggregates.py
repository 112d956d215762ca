"""Aggregation per key. Everything here is a partial aggregate merged after the
shuffle, or a join of such aggregates; no key is gathered in one task."""

from __future__ import annotations

import itertools
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .ordered import AUTO, attach, by_key, group_quantiles, listed, point, running, same_keys
from ..functions.scalars import clip, safe_div


def _present(c, order):
    """The order, on rows where the column has a value."""
    return F.when(F.col(c).isNotNull(), point(order))


def numeric_profile(df, keys, order, cols):
    """Mean, sample deviation, min, max, first and last non-NULL value per key."""
    keys, order = listed(keys), listed(order)
    out = []
    for c in listed(cols):
        at = _present(c, order)
        out += [
            F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"), F.min_by(c, at).alias(f"{c}_first"), F.max_by(c, at).alias(f"{c}_last"),
        ]
    return df.groupBy(*keys).agg(*out)


def profile_deltas(df, cols):
    """Differences and ratios of the last value to first, mean and max; the last value to 2 places."""
    new = {}
    for c in listed(cols):
        last = F.col(f"{c}_last")
        new[f"{c}_last_rounded"] = F.bround(last, 2)
        for other in ("first", "mean", "max"):
            new[f"{c}_last_{other}_sub"] = last - F.col(f"{c}_{other}")
            new[f"{c}_last_{other}_div"] = safe_div(last, F.col(f"{c}_{other}"))
    return df.withColumns(new)


def category_profile(df, keys, order, cols):
    """Count, first, last and number of distinct values per key."""
    order, out = listed(order), []
    for c in listed(cols):
        at = _present(c, order)
        out += [
            F.count(c).alias(f"{c}_count"), F.min_by(c, at).alias(f"{c}_first"),
            F.max_by(c, at).alias(f"{c}_last"), F.count_distinct(c).alias(f"{c}_nunique"),
        ]
    return df.groupBy(*listed(keys)).agg(*out)


def tail_rows(df, keys, order, n):
    """The last n rows per key with ``_back`` = 1 for the latest; the filter limits rows before the shuffle."""
    w = W.partitionBy(*listed(keys)).orderBy(*[F.col(c).desc() for c in listed(order)])
    return df.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= n)


def last_diff(df, keys, order, cols):
    """Last value minus the one before it; NULL for a single row."""
    two = tail_rows(df, keys, order, 2)
    at = lambda c, i: F.max(F.when(F.col("_back") == i, F.col(c)))
    return two.groupBy(*listed(keys)).agg(*[(at(c, 1) - at(c, 2)).alias(f"{c}_last_diff") for c in listed(cols)])


def mean_before_last(df, keys, order, cols, ns):
    """Mean of all rows but the latest n: totals less the totals of those rows."""
    keys, cols = listed(keys), listed(cols)
    whole = df.groupBy(*keys).agg(*[f(c).alias(f"_{s}_{c}") for c in cols for s, f in (("s", F.sum), ("n", F.count))])
    tail = tail_rows(df, keys, order, max(ns)).groupBy(*keys).agg(*[
        f(F.when(F.col("_back") <= n, F.col(c))).alias(f"_{s}_{c}_{n}")
        for c in cols for n in ns for s, f in (("s", F.sum), ("n", F.count))
    ])
    both = same_keys(whole, tail, keys, "left")
    got = []
    for c, n in itertools.product(cols, ns):
        left = F.col(f"_n_{c}") - F.col(f"_n_{c}_{n}")
        rest = F.col(f"_s_{c}") - F.coalesce(f"_s_{c}_{n}", F.lit(0.0))
        got.append(F.when(left > 0, rest / left).alias(f"{c}_mean_before_{n}"))
    return both.select(*keys, *got)


def conditional_agg(df, keys, aggs: dict[str, Column]):
    """Named aggregates, written with ``F.when`` inside, over one pass."""
    return df.groupBy(*listed(keys)).agg(*[c.alias(n) for n, c in aggs.items()])


def content_profile(df, keys, col, name="content"):
    """Share of all rows, mean, deviation, min, max and exact median of a value per key."""
    keys = listed(keys)
    total = df.agg(F.count(F.lit(1)).alias("_all"))  # one row
    per = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(col).alias(f"{name}_avg"), F.stddev_samp(col).alias(f"{name}_std"),
        F.min(col).alias(f"{name}_min"), F.max(col).alias(f"{name}_max"),
    )
    per = per.transform(attach, total).withColumn(f"{name}_share", F.col("_n") / F.col("_all")).drop("_n", "_all")
    return same_keys(per, group_quantiles(df, keys, col, [0.5], names=lambda q: f"{name}_median"), keys, "left")


def median(df, keys, col):
    """Exact median per key."""
    return group_quantiles(df, keys, col, [0.5], names=lambda q: f"{col}_median")


def quantile_nearest(df, keys, col, qs):
    """Quantiles that are values of the data: the nearest rank, half to even."""
    return group_quantiles(df, keys, col, qs, "nearest")


def keyword_aggs(df, keys, text, value, words):
    """Count, mean, deviation, max and sum of a value over rows whose text holds a word."""
    aggs = []
    for w in words:
        x = F.when(F.col(text).contains(w), F.col(value))
        aggs += [
            F.count(x).alias(f"{w}_count"), F.avg(x).alias(f"{w}_mean"), F.stddev_samp(x).alias(f"{w}_std"),
            F.max(x).alias(f"{w}_max"), F.sum(x).alias(f"{w}_sum"),
        ]
    return df.groupBy(*listed(keys)).agg(*aggs)


def keyword_medians(df, keys, text, value, words):
    """Exact median per key and word of the rows that hold the word."""
    keys = listed(keys)
    hits = F.array_compact(F.array(*[F.when(F.col(text).contains(w), F.lit(w)) for w in words]))
    long = df.select(*keys, value, F.explode(hits).alias("word"))
    return group_quantiles(long, keys + ["word"], value, [0.5], names=lambda q: "median")


def category_pivot_aggs(df, keys, cat, values, cols, aggs=("sum", "avg", "std", "max", "min")):
    """Per category value: row count, and aggregates of the columns.

    Aggregated long by (key, category) first, then laid out wide, so wide value
    lists do not make wide aggregation buffers.
    """
    keys, fs = listed(keys), {"sum": F.sum, "avg": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}
    long = df.groupBy(*keys, cat).agg(
        F.count(F.lit(1)).alias("count"), *[fs[a](c).alias(f"{c}_{a}") for c in listed(cols) for a in aggs]
    )
    fields = ["count"] + [f"{c}_{a}" for c in listed(cols) for a in aggs]
    out = []
    for v in values:
        for f in fields:
            x = F.max(F.when(F.col(cat) == v, F.col(f)))
            out.append((F.coalesce(x, F.lit(0)) if f == "count" else x).alias(f"{v}_{f}"))
    return long.groupBy(*keys).agg(*out)


def numeric_aggs(df, keys, cols, aggs=("mean", "std", "sum")):
    fs = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}
    return df.groupBy(*listed(keys)).agg(*[fs[a](c).alias(f"{c}_{a}") for c in listed(cols) for a in aggs])


def conditional_span(df, keys, col, preds: dict[str, Column]):
    """max - min of the rows that meet each predicate; 0 if none does."""
    span = lambda p: F.coalesce(F.max(F.when(p, F.col(col))) - F.min(F.when(p, F.col(col))), F.lit(0))
    return df.groupBy(*listed(keys)).agg(*[span(p).alias(n) for n, p in preds.items()])


def value_counts(df, cols, normalize=False):
    """Rows per value and, if asked, their share."""
    out = df.groupBy(*listed(cols)).agg(F.count(F.lit(1)).alias("count"))
    if not normalize:
        return out
    total = out.agg(F.sum("count").alias("_all"))
    return out.transform(attach, total).withColumn("share", F.col("count") / F.col("_all")).drop("_all")


def count_of_counts(df, keys):
    """How many keys have each row count, and the running share of keys."""
    sizes = df.groupBy(*listed(keys)).agg(F.count(F.lit(1)).alias("size"))
    out = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("keys"))
    out = running(out.withColumn("_all", F.lit(0)), "_all", ["size"], ["keys"], ["sum"], names=lambda c, a: "_cum")
    total = out.groupBy("_all").agg(F.sum("keys").alias("_n"))
    return out.drop("_all").transform(attach, total.select("_n")).select("size", "keys", (F.col("_cum") / F.col("_n")).alias("cum_share"))


def nunique_by_month(df, col, ts):
    return df.groupBy(F.date_format(F.col(ts), "yyyy-MM").alias("month")).agg(F.count_distinct(col).alias(f"{col}_nunique"))


def active_items(df, item, ts, since):
    """Items with a row on or after a date."""
    return df.filter(F.col(ts) >= F.lit(since).cast("date")).select(item).distinct()


def recency(df, keys, ts, cap=None):
    """Days from the key's last row to the latest day of the table, capped, and scaled to 0..1."""
    last = df.groupBy(*listed(keys)).agg(F.max(F.to_date(ts)).alias("_last"))
    latest = df.agg(F.max(F.to_date(ts)).alias("_latest"))
    days = F.coalesce(F.datediff("_latest", "_last"), F.lit(-1)).cast("bigint")
    out = last.transform(attach, latest).withColumn("recency", days if cap is None else clip(days, -1, cap))
    return out.withColumn("recency_scaled", F.col("recency") / F.lit(float(cap or 1))).drop("_last", "_latest")


def activity_profile(df, keys, ts, rating, values):
    """Row count, count per value of a rating column, count per weekday (Monday 0)."""
    days = [F.count_if(F.weekday(ts) == i).alias(f"weekday_{i}") for i in range(7)]
    marks = [F.count_if(F.col(rating) == v).alias(f"{rating}_{v}") for v in values]
    return df.groupBy(*listed(keys)).agg(F.count(F.lit(1)).alias("count"), *marks, *days)


def hierarchy_sum(df, levels: dict[str, list[str]], aggs: dict[str, str]):
    """Sums over several grouping levels, one row per level and group.

    Rows are first summed to the finest grain, so the expansion over the levels
    multiplies that small table only. ``levels`` names each level's columns;
    ``aggs`` maps output to input column.
    """
    dims = list(dict.fromkeys(c for cols in levels.values() for c in cols))
    fine = df.groupBy(*dims).agg(*[F.sum(c).alias(n) for n, c in aggs.items()])
    sets = [[F.col(c) for c in cols] for cols in levels.values()]
    gid = F.grouping_id(*[F.col(c) for c in dims]).alias("_gid")
    out = fine.groupingSets(sets, *[F.col(c) for c in dims]).agg(gid, *[F.sum(n).alias(n) for n in aggs])
    bit = {c: 1 << (len(dims) - 1 - i) for i, c in enumerate(dims)}
    label = F.lit(None).cast("string")
    for name, cols in levels.items():
        label = F.when(F.col("_gid") == sum(v for c, v in bit.items() if c not in cols), F.lit(name)).otherwise(label)
    return out.withColumn("level", label).select("level", *dims, *aggs)


def hierarchy_weights(df, levels, value):
    """Share of a value (say, recent revenue) within each level, over the number of levels."""
    sums = hierarchy_sum(df, levels, {"_v": value})
    totals = sums.groupBy("level").agg(F.sum("_v").alias("_t"))  # one row per level
    out = sums.join(F.broadcast(totals), "level")
    return out.withColumn("weight", F.col("_v") / F.col("_t") / len(levels)).drop("_v", "_t")


def series_scale(df, keys, order, col, split=AUTO):
    """Mean squared step of a series from its first non-zero value on."""
    keys, order = listed(keys), listed(order)
    first = F.min(F.when(F.col(col) != 0, point(order)))
    if split is None:  # small keys: the window shares the sort key of the steps
        live = df.withColumn("_first", first.over(W.partitionBy(*keys)))
    else:
        live = same_keys(df, df.groupBy(*keys).agg(first.alias("_first")), keys, "inner")
    live = live.filter(point(order) >= F.col("_first")).drop("_first")

    def step(d, ks):
        return d.withColumn("_d", F.col(col) - F.lag(col).over(W.partitionBy(*ks).orderBy(*order)))

    return by_key(live, keys, order, step, before=1, split=split).groupBy(*keys).agg(F.avg(F.col("_d") * F.col("_d")).alias("scale"))


def quantile_expand(df, levels, value, ratios: dict[str, dict[float, float]]):
    """Sum per level and group times each quantile's ratio for that level."""
    sums = hierarchy_sum(df, levels, {value: value})
    rows = [(lv, float(q), float(r)) for lv, m in ratios.items() for q, r in m.items()]
    table = df.sparkSession.createDataFrame(rows, "level string, quantile double, ratio double")  # levels x quantiles
    out = sums.join(F.broadcast(table), "level")
    return out.withColumn(value, F.col(value) * F.col("ratio")).drop("ratio")


def error_by_group(df, keys, y, p, bin_digits=None):
    """Rows and root mean squared error per group, or per rounded absolute error."""
    err = F.col(p) - F.col(y)
    if bin_digits is not None:
        df, keys = df.withColumn("error_bin", F.bround(F.abs(err), bin_digits)), ["error_bin"]
    return df.groupBy(*listed(keys)).agg(F.count(F.lit(1)).alias("count"), F.sqrt(F.avg(err * err)).alias("rmse"))


def inverse_freq_weight(df, col, digits=1, scale=1.0, name="weight"):
    """One less the share of rows with the same rounded value, scaled."""
    binned = df.withColumn("_bin", F.bround(col, digits))
    shares = value_counts(binned, "_bin", normalize=True).drop("count")
    return same_keys(binned, shares, ["_bin"], "left").withColumn(name, (1 - F.col("share")) * scale).drop("_bin", "share")


def inverse_group_weight(df, keys, name="weight"):
    """1 over the rows of the key."""
    keys = listed(keys)
    sizes = df.groupBy(*keys).agg((1 / F.count(F.lit(1))).alias(name))
    return same_keys(df, sizes, keys, "left")


def argmax_row(df, keys, col, order):
    """The row of the largest value per key; ties go to the earliest in order."""
    w = W.partitionBy(*listed(keys)).orderBy(F.col(col).desc_nulls_last(), *listed(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def row_mode(cols, name="mode") -> Column:
    """Most frequent value across columns; ties go to the leftmost."""
    a = F.filter(F.array(*cols), lambda x: x.isNotNull())
    count = lambda x: F.size(F.filter(a, lambda y: y == x))
    scored = F.transform(a, lambda x, i: F.struct(count(x).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.array_max(scored)["x"].alias(name)


def row_stats(cols, prefix="row") -> dict[str, Column]:
    """Mean, min, max, sample deviation and median across columns, NULL skipped."""
    a = F.array_sort(F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull()))
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    square = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    mid = (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2
    return {
        f"{prefix}_mean": F.when(n > 0, mean), f"{prefix}_min": F.array_min(a), f"{prefix}_max": F.array_max(a),
        f"{prefix}_std": F.when(n > 1, F.sqrt(square / (n - 1))), f"{prefix}_median": F.when(n > 0, mid),
    }


def blend(dfs: list[DataFrame], keys, col, weights=None):
    """Weighted mean of several predictions of the same rows; with decimal predictions the weights are decimals too, without a rounding error."""
    weights = weights or [1.0] * len(dfs)

    def weight(d, w):
        return F.lit(Decimal(str(w)) if isinstance(d.schema[col].dataType, T.DecimalType) else float(w))

    parts = [d.select(*listed(keys), (F.col(col) * weight(d, w)).alias("_v"), weight(d, w).alias("_w")) for d, w in zip(dfs, weights)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*listed(keys)).agg((F.sum("_v") / F.sum("_w")).alias(col))


def describe(df, numeric, strings=()):
    """One row per column: count, mean, deviation, min, quartiles, max; for strings the
    distinct count, the most frequent value and its count (ties: the smallest)."""
    parts = []
    for c in listed(numeric):
        q = group_quantiles(df.select(F.lit(c).alias("column"), c), "column", c, [0.25, 0.5, 0.75], names=lambda q: f"q{int(q * 100)}")
        s = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
        parts.append(q.transform(attach, s))
    for c in listed(strings):
        n = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        top = n.groupBy("n").agg(F.min(c).alias("v"), F.count(F.lit(1)).alias("k"))
        parts.append(top.agg(
            F.lit(c).alias("column"), F.sum(F.col("n") * F.col("k")).alias("count"), F.sum("k").alias("unique"),
            F.max_by("v", "n").alias("top"), F.max("n").alias("freq"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
