"""Set operations, wide/long layouts and composite keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import map_values
from .ordered import attach, listed, positions, same_keys


def union(*dfs):
    """Rows of all tables by column name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_labeled(parts: dict[str, DataFrame], name="part"):
    """Rows of all tables with the label of their table."""
    return union(*[d.withColumn(name, F.lit(label)) for label, d in parts.items()])


def key_sets(left, right, cols):
    """Each distinct key with whether the left and right tables hold it: union, intersection and difference in one pass."""
    cols = listed(cols)
    both = union_labeled({"l": left.select(*cols), "r": right.select(*cols)}, "_side")
    has = lambda s: F.max((F.col("_side") == s).cast("int"))
    return both.groupBy(*cols).agg(has("l").alias("in_left"), has("r").alias("in_right"))


def melt_days(df, ids, prefix="d_", value="value", name="d"):
    """Day columns such as d_17 to rows with the day number."""
    days = [c for c in df.columns if c.startswith(prefix)]
    long = df.unpivot(listed(ids), days, "_day", value)
    return long.withColumn(name, F.regexp_extract("_day", r"(\d+)$", 1).cast("bigint")).drop("_day")


def melt_suffix(df, ids, stems, years, sep="_", name="year"):
    """Columns such as pct_2019, pct_2020 to one row per year with a column per stem."""
    rows = F.array(*[F.struct(F.lit(y).alias(name), *[F.col(f"{s}{sep}{y}").alias(s) for s in listed(stems)]) for y in years])
    return df.select(*listed(ids), F.explode(rows).alias("_r")).select(*listed(ids), "_r.*")


def extend_horizon(df, keys, step, n):
    """Add n further steps with NULL values after the last step of the table, for every key."""
    keys = listed(keys)
    last = df.agg(F.max(step).alias("_last"))
    ahead = df.select(*keys).distinct().transform(attach, last)
    ahead = ahead.select(*keys, F.explode(F.sequence(F.col("_last") + 1, F.col("_last") + n)).alias(step))
    return union(df, ahead)


def pivot_forecast(df, ids, step, value, first, n, prefix="F"):
    """Steps first..first+n-1 to columns F1..Fn."""
    out = [F.max(F.when(F.col(step) == first + i, F.col(value))).alias(f"{prefix}{i + 1}") for i in range(n)]
    return df.filter(F.col(step).between(first, first + n - 1)).groupBy(*listed(ids)).agg(*out)


def pivot_ranked(df, keys, rank, cols, n):
    """Columns of the rows ranked 1..n, side by side."""
    at = lambda c, i: F.max(F.when(F.col(rank) == i, F.col(c))).alias(f"{c}_{i}")
    return df.filter(F.col(rank) <= n).groupBy(*listed(keys)).agg(*[at(c, i) for i in range(1, n + 1) for c in listed(cols)])


def to_intervals(df, keys, order, event, time, start="start", end="end"):
    """The i-th start and the i-th end of a key as one row."""
    keys = listed(keys)
    marks = positions(df.filter(F.col(event).isin(start, end)), keys + [event], order, "interval")
    at = lambda v: F.max(F.when(F.col(event) == v, F.col(time)))
    return marks.groupBy(*keys, "interval").agg(at(start).alias("start"), at(end).alias("end"))


def parse_delimited(df, col, names, maps=None, sep="-"):
    """Parts of a delimited string as named columns, some mapped to codes."""
    parts = F.split(F.col(col), sep)
    get = {n: F.get(parts, F.lit(i)) for i, n in enumerate(names)}
    for n, m in (maps or {}).items():
        get[n] = map_values(get[n], m)
    return df.withColumns(get)


def stack_stages(df, keys, stage, order_values, aggs):
    """Aggregates per stage, each stage's row also carrying those of the earlier stages.

    One row per key and stage present; columns are prefixed by the stage they come from.
    """
    keys = listed(keys)
    per = df.groupBy(*keys, stage).agg(*[c.alias(n) for n, c in aggs.items()])
    at = lambda v, n: F.max(F.when(F.col(stage) == v, F.col(n)))
    wide = per.groupBy(*keys).agg(*[at(v, n).alias(f"{v}_{n}") for v in order_values for n in aggs])
    rank = map_values(F.col(stage), {v: i for i, v in enumerate(order_values)})
    out = same_keys(per.select(*keys, stage), wide, keys, "inner").withColumn("_rank", rank)
    for i, v in enumerate(order_values):
        out = out.withColumns({f"{v}_{n}": F.when(F.col("_rank") >= i, F.col(f"{v}_{n}")) for n in aggs})
    return out.drop("_rank")


def pivot_measures(df, order, entity, values, cols):
    """One row per step with a column per entity and measure, in sorted order."""
    at = lambda v, c: F.max(F.when(F.col(entity) == v, F.col(c))).alias(f"{v}_{c}")
    names = sorted((v, c) for v in values for c in listed(cols))
    return df.groupBy(*listed(order)).agg(*[at(v, c) for v, c in names])
