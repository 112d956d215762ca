"""Projection, filtering, encoding of categories and column profiles."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.scalars import clip, correlation, map_values
from .ordered import attach, by_key, group_quantiles, listed, point, positions_all, same_keys


def fill_null(df, how, cols=None):
    """Fill NULL by a constant, a dict of constants per column, or "mean"."""
    if how != "mean":
        return df.fillna(how, subset=cols) if not isinstance(how, dict) else df.fillna(how)
    cols = listed(cols)
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])  # one row
    out = df.transform(attach, means).withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols})
    return out.drop(*[f"_m_{c}" for c in cols])


def column_profile(df, cols=None, approximate=False):
    """One row per column: share of NULL, distinct non-NULL values, sample variance (numbers), min and max as double.

    One pass over the table; distinct counts may be approximate on request.
    """
    cols = listed(cols or df.columns)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    none = F.lit(None).cast("double")
    parts = []
    for c in cols:
        num = c in numeric
        parts.append(F.struct(
            F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("null_rate"), distinct(c).alias("distinct"),
            (F.var_samp(c) if num else none).alias("variance"),
            (F.min(c).cast("double") if num else none).alias("min"), (F.max(c).cast("double") if num else none).alias("max"),
        ))
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def _names(df, cond) -> list[str]:
    return [r["column"] for r in df.filter(cond).select("column").collect()]  # at most one row per column


def high_null_cols(df, t, cols=None):
    """Columns with a NULL share above t."""
    return _names(column_profile(df, cols, approximate=True), F.col("null_rate") > t)


def low_unique_cols(df, t=1, cols=None):
    """Columns with at most t distinct values; only columns whose estimate is near t are counted exactly."""
    near = _names(column_profile(df, cols, approximate=True), F.col("distinct") <= 2 * t + 10)
    return _names(column_profile(df, near), F.col("distinct") <= t) if near else []


def low_variance_cols(df, t, cols=None):
    """Number columns with a variance below t."""
    return _names(column_profile(df, cols, approximate=True), F.col("variance") < t)


def corr_pairs(df, cols):
    """Pearson correlation of each pair of columns, in one aggregation pass."""
    pairs = list(combinations(listed(cols), 2))
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(a, b).alias("r")) for a, b in pairs])
    return df.agg(rows.alias("p")).select(F.explode("p").alias("p")).select("p.*")


def high_corr_cols(df, cols, t):
    """Columns to drop so that no kept pair correlates above t; the later of a pair goes."""
    high = {(r["a"], r["b"]) for r in corr_pairs(df, cols).filter(F.col("r") > t).collect()}
    dropped: list[str] = []
    for a, b in combinations(listed(cols), 2):
        if (a, b) in high and a not in dropped and b not in dropped:
            dropped.append(b)
    return dropped


def target_corr(df, cols, y):
    """Correlation of each column with the target."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), correlation(c, y).alias("r")) for c in listed(cols)])
    return df.agg(rows.alias("p")).select(F.explode("p").alias("p")).select("p.*")


def winsorize(df, keys, col, lo=0.05, hi=0.95, order=None, after_first_nonzero=False, digits=None):
    """Bound values to quantiles of their key, optionally those after the leading zeros, then round."""
    keys, base = listed(keys), df
    if after_first_nonzero:
        first = df.groupBy(*keys).agg(F.min(F.when(F.col(col) != 0, point(listed(order)))).alias("_first"))
        base = same_keys(df, first, keys, "inner").filter(point(listed(order)) >= F.col("_first"))
    q = group_quantiles(base, keys, col, [lo, hi], names=lambda q: "_lo" if q == lo else "_hi")
    out = same_keys(df, q, keys, "left")
    x = F.when(F.col("_lo").isNull(), F.col(col)).otherwise(clip(col, F.col("_lo"), F.col("_hi")))
    return out.withColumn(col, x if digits is None else F.bround(x, digits)).drop("_lo", "_hi")


def equal_width_bin(df, col, n=None, name="bin"):
    """Bins of equal width, numbered from 0, closed on the right; the count is floor(1 + log2 rows) if not given."""
    s = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    bins = F.floor(1 + F.log2("_n")) if n is None else F.lit(n)
    at = F.ceil((F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    out = df.transform(attach, s)
    return out.withColumn(name, F.least(F.greatest(at, F.lit(1)), bins) - 1).drop("_lo", "_hi", "_n")


def label_map(df, col, start=0):
    """Code per distinct non-NULL value in sorted order."""
    values = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.lit(1).alias("_one"))
    return positions_all(values, [col], "code").select(col, (F.col("code") - 1 + start).alias("code"))


def label_encode(df, col, fit=None, start=0, keep_null=False, name=None):
    """Code of a value among the sorted values of ``fit`` (the table itself if not given).

    Unknown values and NULL get NULL; without ``keep_null`` a NULL gets the code
    after the last.
    """
    fitted = label_map(df if fit is None else fit, col, start)
    coded = same_keys(df, fitted.withColumnRenamed("code", "_code"), [col], "left")
    code = F.col("_code")
    if not keep_null:
        last = fitted.agg(F.max("code").alias("_last"))
        coded = coded.transform(attach, last)
        code = F.when(F.col(col).isNull(), F.coalesce(F.col("_last") + 1, F.lit(start))).otherwise(code)
    return coded.withColumn(name or f"{col}_code", code).drop("_code", "_last")


def factorize(df, col, order, name=None):
    """Code by first appearance in the order; NULL gets -1."""
    firsts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.min(point(listed(order))).alias("_at"))
    codes = positions_all(firsts, ["_at"], "_code").select(col, "_code")
    out = same_keys(df, codes, [col], "left")
    return out.withColumn(name or f"{col}_code", F.coalesce(F.col("_code") - 1, F.lit(-1))).drop("_code")


def one_hot(df, col, values):
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values})


def multi_hot(df, col, values, sep=" "):
    """1 for each given tag in a separated list."""
    tags = F.split(F.col(col), sep)
    return df.withColumns({f"{col}_{v}": F.coalesce(F.array_contains(tags, str(v)).cast("int"), F.lit(0)) for v in values})


def recode(df, col, mapping, default=None, name=None):
    return df.withColumn(name or col, map_values(col, mapping, default))


def dedupe(df, keys, order, keep="first"):
    """One row per key: the first or last in order."""
    o = [F.col(c) if keep == "first" else F.col(c).desc() for c in listed(order)]
    rn = F.row_number().over(W.partitionBy(*listed(keys)).orderBy(*o))
    return df.withColumn("_rn", rn).filter(F.col("_rn") == 1).drop("_rn")


def duplicated(df, keys, name="duplicated"):
    """Flag rows whose key occurs more than once."""
    keys = listed(keys)
    many = df.groupBy(*keys).agg((F.count(F.lit(1)) > 1).alias(name))
    return same_keys(df, many, keys, "left")


def drop_null_rows(df, regex):
    """Drop rows with a NULL in a column whose name matches."""
    return df.dropna(subset=[c for c in df.columns if re.search(regex, c)])


def _fell(df, keys, order, col):
    """First point of each key where the column is below the row before it; NULL if never."""
    def step(d, ks):
        w = W.partitionBy(*ks).orderBy(*listed(order))
        return d.withColumn("_fell", F.col(col) < F.lag(col).over(w))

    marked = by_key(df, keys, order, step, before=1)
    return marked.groupBy(*listed(keys)).agg(F.min(F.when(F.col("_fell"), point(listed(order)))).alias("_bad"))


def drop_after_regression(df, keys, order, col):
    """Rows of a key before its column first goes backwards."""
    bad = _fell(df, keys, order, col)
    out = same_keys(df, bad, listed(keys), "inner")
    return out.filter(F.col("_bad").isNull() | (point(listed(order)) < F.col("_bad"))).drop("_bad")


def is_monotonic(df, keys, order, col, name="monotonic"):
    """Whether the column never falls within the key."""
    return _fell(df, keys, order, col).select(*listed(keys), F.col("_bad").isNull().alias(name))


def narrow_types(df, cols=None):
    """Cast numbers to the smallest type that holds the observed range."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in listed(cols or df.columns) if isinstance(fields[c], T.NumericType)]
    ranges = {r["column"]: (r["min"], r["max"]) for r in column_profile(df, cols, approximate=True).collect()}
    sizes = [("byte", 2**7), ("short", 2**15), ("int", 2**31)]
    casts = {}
    for c in cols:
        lo, hi = ranges[c]
        if isinstance(fields[c], (T.DoubleType, T.FloatType)):
            casts[c] = F.col(c).cast("float")
        elif lo is not None:
            fit = [t for t, top in sizes if -top <= lo and hi < top]
            if fit:
                casts[c] = F.col(c).cast(fit[0])
    return df.withColumns(casts) if casts else df


def mirror_augment(df, pairs, negate=(), complement=()):
    """The rows, and the rows with paired columns swapped, some negated and some taken from 1; flagged ``is_raw``."""
    swap = {a: b for a, b in pairs} | {b: a for a, b in pairs}
    new = []
    for c in df.columns:
        x = F.col(swap.get(c, c))
        new.append((-x if c in negate else 1 - x if c in complement else x).alias(c))
    return df.withColumn("is_raw", F.lit(1)).unionByName(df.select(*new).withColumn("is_raw", F.lit(0)))


def sample_background(df, key, time, event, rate, seed=0, draw: Column | None = None):
    """Background events at a random time between neighbouring start and end marks, for a share of the gaps.

    ``draw`` is a uniform column over (key, time); a hash of them with the seed if
    not given. Times that any event of the table has are left out.
    """
    def step(d, ks):
        w = W.partitionBy(*ks).orderBy(time)
        return d.withColumn("_next", F.lead(time).over(w))

    gaps = by_key(df.filter(F.col(event).isin("start", "end")).select(key, time), [key], [time], step, after=1)
    uniform = lambda s: F.pmod(F.xxhash64(F.col(key), F.col(time), F.lit(seed), F.lit(s)), F.lit(1 << 30)) / float(1 << 30)
    at, chosen = (uniform(1), uniform(2)) if draw is None else (draw, draw)
    picked = gaps.filter(F.col("_next").isNotNull() & (chosen < rate))
    picked = picked.select(key, (F.col(time) + (F.col("_next") - F.col(time)) * at).alias(time), F.lit("background").alias(event))
    return picked.join(df.select(F.col(time).alias(time)).distinct(), time, "left_anti").select(key, time, event)


def drop_null_target(df, y):
    return df.filter(F.col(y).isNotNull())


def mask_inactive(df, since, col, n):
    """NULL the target where more than n steps passed since the last positive row."""
    return df.withColumn(col, F.when(F.col(since) > n, None).otherwise(F.col(col)))
