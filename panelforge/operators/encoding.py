"""Target and value encodings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from .ordered import attach, listed, point, same_keys
from .windows import transform_agg


def group_target_stats(df, keysets: dict[str, list[str]], y, entity=None):
    """Mean and deviation of the target over each key set beside the rows; with ``entity``,
    a flag where the entity's mean exceeds the group's."""
    out = df
    if entity:
        out = transform_agg(out, entity, {"_entity": F.avg(y)})
    for name, cols in keysets.items():
        out = transform_agg(out, cols, {f"{name}_mean": F.avg(y), f"{name}_std": F.stddev_samp(y)})
        if entity:
            out = out.withColumn(f"{name}_above", (F.col("_entity") > F.col(f"{name}_mean")).cast("int"))
    return out.drop("_entity")


def target_fit(df, col, y, smooth):
    """Smoothed mean per category over all rows, for use on new data, with the overall mean."""
    mean = df.agg(F.avg(y).alias("_m"))
    per = df.groupBy(col).agg(F.sum(y).alias("_s"), F.count(y).alias("_n")).transform(attach, mean)
    return per.select(col, ((F.col("_s") + smooth * F.col("_m")) / (F.col("_n") + smooth)).alias("encoded"), F.col("_m").alias("overall"))


def target_encode(df, col, y, fold, smooth=10.0, mode="oof", name=None):
    """Smoothed mean of the target per category.

    ``oof``: from the rows of the other folds; ``within``: from the own fold, unsmoothed.
    """
    name = name or f"{col}_te"
    if mode == "within":
        return transform_agg(df, [fold, col], {name: F.avg(y)})
    per_fold = df.groupBy(col, fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    totals = per_fold.groupBy(col).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    mean = per_fold.agg((F.sum("_s") / F.sum("_n")).alias("_m"))
    rest_s, rest_n = F.col("_ts") - F.coalesce("_s", F.lit(0)), F.col("_tn") - F.col("_n")
    table = same_keys(per_fold, totals, [col], "inner").transform(attach, mean)
    table = table.select(col, fold, ((rest_s + smooth * F.col("_m")) / (rest_n + smooth)).alias(name))
    return same_keys(df, table, [col, fold], "left")


def target_apply(df, fitted, col, name=None):
    """Encoding of new data; an unknown category gets the overall mean."""
    name = name or f"{col}_te"
    overall = fitted.agg(F.max("overall").alias("_m"))
    out = same_keys(df, fitted.select(col, F.col("encoded").alias(name)), [col], "left").transform(attach, overall)
    return out.withColumn(name, F.coalesce(name, "_m")).drop("_m")


def pair_target_encode(df, cols, fold, y, one=1.0, zero=0.0):
    """Share of rows at the top, at zero and between, per fold and pair of categories.

    Rows are counted once per fold and all categories; every pair sums that table.
    """
    cols = listed(cols)
    is_one, is_zero = F.col(y) == one, F.col(y) == zero
    fine = df.groupBy(fold, *cols).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(is_one).alias("_one"), F.count_if(is_zero).alias("_zero")
    )
    out = df
    for a, b in combinations(cols, 2):
        n, p, z = F.sum("_n"), F.sum("_one"), F.sum("_zero")
        per = fine.groupBy(fold, a, b).agg(
            (p / n).alias(f"{a}_{b}_one"), (z / n).alias(f"{a}_{b}_zero"), ((n - p - z) / n).alias(f"{a}_{b}_between")
        )
        out = same_keys(out, per, [fold, a, b], "left")
    return out


def gaussian_encode(df, keys, y, prior_cols=None, precision=1000.0, stat="mean", name="encoded"):
    """Posterior of a group's mean: the group's own estimate weighed against its prior.

    The prior is the overall mean, or the mean of earlier encodings of the rows. A
    group without a usable variance falls back to the row's prior.
    """
    keys = listed(keys)
    if prior_cols:
        base = df.withColumn("_p", sum((F.col(c) for c in prior_cols), F.lit(0.0)) / len(prior_cols))
    else:
        base = df.transform(attach, df.agg(F.avg(y).alias("_p")))
    s = base.groupBy(*keys).agg(F.count(y).alias("_n"), F.avg(y).alias("_mu"), F.var_samp(y).alias("_v"), F.avg("_p").alias("_mp"))
    own = F.try_divide(F.col("_n").cast("double"), F.col("_v"))
    total = precision + own
    value = {"mean": (precision * F.col("_mp") + own * F.col("_mu")) / total, "var": 1 / total, "precision": total}[stat]
    out = same_keys(base, s.select(*keys, value.alias(name)), keys, "left")
    return out.withColumn(name, F.coalesce(name, "_p")).drop("_p")


def last_value(df, keys, order, col, before=None, name="last_value"):
    """Last non-NULL value per key, optionally before a point of the first order column."""
    order = listed(order)
    d = df if before is None else df.filter(F.col(order[0]) < before)
    return d.groupBy(*listed(keys)).agg(F.max_by(col, F.when(F.col(col).isNotNull(), point(order))).alias(name))


def apply_override(df, overrides, keys, col, growth=1.0):
    """Replace values by those of an override table where given, else scale by a growth ratio."""
    table = overrides.select(*listed(keys), F.col(col).alias("_o"))
    out = same_keys(df, table, listed(keys), "left")
    return out.withColumn(col, F.coalesce(F.col("_o"), F.col(col) * growth)).drop("_o")
