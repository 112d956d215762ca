"""Ordered sequences per key as arrays of bounded length, and array helpers."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .aggregates import tail_rows
from .ordered import AUTO, listed, positions, same_keys
from .ranking import top_rows


def _gather(df, keys, order, cols):
    order, cols = listed(order), listed(cols)
    at = F.struct(F.struct(*order).alias("_o"), F.struct(*cols).alias("_v"))
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(at)).alias("_a"))

    def field(c):
        return F.transform("_a", lambda x: x["_v"][c]).alias(c)

    return packed.select(*keys, *[field(c) for c in cols])


def sequences(df, keys, order, cols, chunk, split=AUTO):
    """Aligned arrays of the columns per key in order, in pieces of at most ``chunk`` rows.

    A key longer than ``chunk`` gives several rows, numbered by ``piece`` from 0, so no array grows without
    bound and nothing is cut off. A piece is not the key: what holds for whole keys is asked of their rows
    (``longer_keys``, ``last_n``, ``first_n``) before they are gathered.
    """
    keys = listed(keys)
    d = positions(df, keys, order, "_pos", split)
    d = d.withColumn("piece", F.floor((F.col("_pos") - 1) / chunk))
    return _gather(d, keys + ["piece"], order, cols)


def last_n(df, keys, order, cols, n):
    """Arrays of the last n rows per key, oldest first; rows beyond n are dropped before the shuffle."""
    return _gather(tail_rows(df, keys, order, n), listed(keys), order, cols)


def first_n(df, keys, order, cols, n):
    """Arrays of the first n rows per key; rows beyond n are dropped before the shuffle."""
    return _gather(top_rows(df, keys, n, *listed(order)).drop("rank"), listed(keys), order, cols)


def chunk(df, keys, order, cols, n, min_size=1):
    """Non-overlapping pieces of n rows; a shorter last piece stays only with ``min_size`` rows."""
    out = sequences(df, keys, order, cols, n)
    return out.filter(F.size(listed(cols)[0]) >= min_size)


def longer_keys(df, keys, n):
    """Rows of the keys that have more than n rows, whatever the size of the key."""
    keys = listed(keys)
    long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > n).select(*keys)
    return same_keys(df, long, keys, "left_semi")


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def pad_left(arr, n, value) -> Column:
    """The last n values, filled on the left."""
    a = _c(arr)
    kept = F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)
    return F.concat(F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(a), F.lit(0))), kept)


def pad_right(arr, n, value) -> Column:
    """The first n values, filled on the right."""
    a = _c(arr)
    return F.concat(F.slice(a, 1, n), F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def shift_right(arr, start) -> Column:
    """The array one step later, with a start value in front."""
    a = _c(arr)
    return F.concat(F.array(F.lit(start)), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))


def pad_mask(arr, value) -> Column:
    """True where the array holds the pad value."""
    return F.transform(_c(arr), lambda x: x == value)


def item_weights(df, keys, item, name="weights"):
    """Map item -> log(count + 10) / log(largest count of the key + 10), one entry per distinct item."""
    keys = listed(keys)
    counted = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_n"))
    top = counted.groupBy(*keys).agg(F.max("_n").alias("_top"))
    w = F.log(F.col("_n") + 10) / F.log(F.col("_top") + 10)
    return same_keys(counted, top, keys, "inner").select(*keys, item, w.alias(name))


def weight_map(weights, keys, item, n, name="weights"):
    """The n heaviest items per key as a map."""
    best = top_rows(weights, keys, n, F.desc(name), F.col(item))
    return best.groupBy(*listed(keys)).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(item, name)))).alias(name))


def multi_hot_map(weights, vocab) -> Column:
    """Array of the map's weight for each value of a fixed vocabulary, 0 where absent."""
    return F.array(*[F.coalesce(F.element_at(_c(weights), F.lit(v)), F.lit(0.0)) for v in vocab])


def parse_int_list(c) -> Column:
    """Text such as [1, 0] as an array of numbers."""
    return F.from_json(_c(c), "array<int>")


def mean_vector(df, keys, order, vec, n, weighted=False):
    """Mean of the last n vectors per key, optionally weighted 1..n towards the latest."""
    keys = listed(keys)
    tail = tail_rows(df, keys, order, n)
    held = tail.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    tail = same_keys(tail, held, keys, "inner")
    w = (F.col("_n") + 1 - F.col("_back")).cast("double") if weighted else F.lit(1.0)
    long = tail.select(*keys, w.alias("_w"), F.posexplode(vec).alias("_i", "_x"))
    dims = long.groupBy(*keys, "_i").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"))
    packed = dims.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_a"))
    return packed.select(*keys, F.transform("_a", lambda x: x["_m"]).alias(vec))


def cosine(a, b) -> Column:
    """Cosine similarity of two vectors; NULL for a zero vector."""
    x, y = F.transform(_c(a), lambda v: v.cast("double")), F.transform(_c(b), lambda v: v.cast("double"))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    return F.try_divide(dot, F.sqrt(total(F.transform(x, lambda v: v * v))) * F.sqrt(total(F.transform(y, lambda v: v * v))))


def group_sizes(df, keys):
    """Rows per query group in key order."""
    keys = listed(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).orderBy(*keys)


def apply_by_piece(df, keys, order, fn, schema, rows, split=AUTO):
    """Run ``fn(pandas frame) -> pandas frame`` over each key's rows in order, in pieces of at most ``rows``.

    For work no expression covers. One call sees one piece: a key longer than ``rows`` is handed over in
    several calls, so ``fn`` must not need the whole key, and no call holds an unbounded group.
    """
    keys, order = listed(keys), listed(order)
    d = positions(df, keys, order, "_pos", split)
    d = d.repartition(*keys, F.floor((F.col("_pos") - 1) / rows)).sortWithinPartitions(*keys, "_pos")
    # a batch holds many pieces; a NULL in one must not turn whole numbers of the others into floats
    whole = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.BooleanType))}
    filled = [F.coalesce(c, F.lit(0).cast(whole[c])).alias(c) if c in whole else F.col(c) for c in df.columns]
    sent = d.select(*filled, *[F.col(c).isNull().alias(f"_no_{c}") for c in whole], "_pos")
    return sent.mapInPandas(_by_piece(fn, rows, {c: isinstance(t, T.BooleanType) for c, t in whole.items()}), schema)


def _by_piece(fn, rows, whole):
    """Call ``fn`` piece by piece over batches of rows in order; ``whole`` names the columns with a NULL mark (True: boolean)."""
    marks = [f"_no_{c}" for c in whole]

    def called(held):
        x = held[0].reset_index(drop=True) if len(held) == 1 else pd.concat(held, ignore_index=True)
        for c, flag in whole.items():
            none = x.pop(f"_no_{c}").eq(True).to_numpy() if f"_no_{c}" in x else np.zeros(0, bool)
            if none.any():
                x[c] = x[c].astype(object).where(~none, None) if flag else x[c].astype(float).where(~none)
        return fn(x)

    def run(batches):
        held = []
        for pdf in batches:
            if not len(pdf):
                continue
            begins = (pdf.pop("_pos").to_numpy() - 1) % rows == 0
            if marks and not pdf[marks].to_numpy().any():
                pdf = pdf.drop(columns=marks)
            cuts, made = [0, *(np.flatnonzero(begins[1:]) + 1).tolist(), len(pdf)], []
            for start, end in zip(cuts, cuts[1:]):
                if held and begins[start]:
                    made.append(called(held))
                    held = []
                held.append(pdf.iloc[start:end])
            for _, alike in itertools.groupby((m for m in made if len(m)), key=lambda m: tuple(m.dtypes)):
                yield pd.concat(list(alike), ignore_index=True)
        if held:
            yield called(held)

    return run
