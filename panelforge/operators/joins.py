"""Joins on time bands, neighbours and intervals, and simple lookups.

None of them compares all pairs of a key: bands meet in time cells, neighbours and
intervals are found by running counts over both sides in one order.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import stored
from .ordered import by_key, fill, listed, running, same_keys, splitters
from .ranking import top_rows

DENSE_CELL = 50_000


def with_null_keys(left, right, keys, how="inner"):
    """Join on keys of the same types where NULL equals NULL, as one struct: a plain equality join, one copy of the keys."""
    keys = listed(keys)
    packed = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    return left.withColumn("_same", packed).join(right.withColumn("_same", packed).drop(*keys), "_same", how).drop("_same")


def join_blocks(blocks: list[DataFrame], keys, how="inner"):
    """Join feature blocks on the entity key."""
    return reduce(lambda a, b: a.join(b, listed(keys), how), blocks)


def lookup(df, table, keys, cols=None):
    """Left join of a table with one row per key; Spark broadcasts it if its size allows."""
    keys = listed(keys)
    return same_keys(df, table if cols is None else table.select(*keys, *listed(cols)), keys, "left")


def semi(df, other, keys):
    """Rows whose key occurs in the other table."""
    return df.join(other.select(*listed(keys)).distinct(), listed(keys), "left_semi")


def anti(df, other, keys):
    """Rows whose key does not occur in the other table."""
    return df.join(other.select(*listed(keys)).distinct(), listed(keys), "left_anti")


def _best(df, part, n, order, unique):
    if unique:
        df = top_rows(df, listed(part) + listed(unique), 1, *order).drop("rank")
    return top_rows(df, part, n, *order)


def band_topk_join(left, right, keys, lid, lt, rt, rid, tol, rank, n, unique=None, dense=DENSE_CELL):
    """For each left row the n right rows of highest ``rank`` within ``tol`` of its time, both ends included.

    Times are whole numbers. ``unique`` columns are kept once per left row. Cells of
    width ``tol`` are the join key, so a left row meets three. In a cell with more
    than ``dense`` right rows, the right rows are first reduced to the best n of each
    dyadic block; the part of the band inside the cell is a few such blocks, so work
    per left row stays bounded whatever the cell holds.
    """
    keys = listed(keys)
    order = [F.desc_nulls_last(rank), F.col(rid)]
    right = right.withColumn("_cell", F.floor(F.col(rt) / tol))
    sizes = right.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    crowded = sizes.filter(F.col("_c") > dense).select(*keys, "_cell", F.lit(True).alias("_dense"))
    right = with_null_keys(right, crowded, keys + ["_cell"], "left")  # no hint: the list grows with the data
    bands = left.select(*keys, lid, F.col(lt).alias("_lt"))
    cell = F.floor(F.col("_lt") / tol)
    bands = bands.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    bands = bands.withColumns({
        "_lo": F.greatest(F.col("_lt") - tol, F.col("_cell") * tol),
        "_hi": F.least(F.col("_lt") + tol + 1, (F.col("_cell") + 1) * tol),
    }).filter(F.col("_lo") < F.col("_hi"))
    bands = with_null_keys(bands, crowded, keys + ["_cell"], "left")
    own = [c for c in right.columns if c not in keys and not c.startswith("_")]

    plain_r = right.filter(F.col("_dense").isNull()).select(*keys, "_cell", *own)
    sparse = with_null_keys(bands.filter(F.col("_dense").isNull()), plain_r, keys + ["_cell"])
    sparse = sparse.filter((F.col(rt) >= F.col("_lo")) & (F.col(rt) < F.col("_hi"))).select(*keys, lid, *own)

    levels = range(max(1, math.ceil(math.log2(tol + 1))) + 1)
    up = lambda c, j: F.shiftright(F.col(c), j)
    blocks = F.array(*[F.struct(F.lit(j).alias("j"), up(rt, j).alias("b")) for j in levels])
    packed = right.filter(F.col("_dense")).withColumn("_blk", F.explode(blocks))
    packed = packed.select(*keys, "_blk.j", "_blk.b", *own)
    packed = _best(packed, keys + ["j", "b"], n, order, unique).drop("rank")
    parts = []
    for j in levels:
        l, r = F.shiftright(F.col("_lo") + ((1 << j) - 1), j), up("_hi", j)
        block = lambda b: F.struct(F.lit(j).alias("j"), b.alias("b"))
        parts.append(F.when((l < r) & (F.pmod(l, F.lit(2)) == 1), block(l)))
        parts.append(F.when((l < r) & (F.pmod(r, F.lit(2)) == 1), block(r - 1)))
    wanted = bands.filter(F.col("_dense")).withColumn("_blk", F.explode(F.array_compact(F.array(*parts))))
    crowd = with_null_keys(wanted.select(*keys, lid, "_blk.j", "_blk.b"), packed, keys + ["j", "b"]).select(*keys, lid, *own)
    return _best(sparse.unionByName(crowd), keys + [lid], n, order, unique)


def _both(left, right, keys, lid, lt, rt, rid, left_first):
    """Left and right times in one table; ``_before`` counts the right rows so far."""
    l = left.select(*keys, F.col(lt).alias("_t"), F.lit(0 if left_first else 1).alias("_s"), F.col(lid).alias("_id"), F.lit(0).alias("_isr"))
    r = right.select(*keys, F.col(rt).alias("_t"), F.lit(1 if left_first else 0).alias("_s"), F.col(rid).alias("_id"), F.lit(1).alias("_isr"))
    return running(l.unionByName(r), keys, ["_t", "_s", "_id"], ["_isr"], ["sum"], names=lambda c, a: "_before")


def neighbors_join(left, right, keys, lid, lt, rt, rid, cols, n, direction="before"):
    """For each left row the n right rows nearest before (or after) its time, strictly, as arrays from the nearest on.

    Right rows are numbered per key; a left row needs a run of n numbers, found by an
    equality join on blocks of n. Left rows without a neighbour are kept with empty arrays.
    """
    keys, cols = listed(keys), listed(cols)
    both = _both(left, right, keys, lid, lt, rt, rid, left_first=direction == "before")
    pos = both.filter(F.col("_isr") == 1).select(*keys, F.col("_id").alias(rid), F.col("_before").alias("_pos"))
    numbered = with_null_keys(right.select(*keys, rid, *cols), pos, keys + [rid]).withColumn("_blk", F.floor((F.col("_pos") - 1) / n))
    at = both.filter(F.col("_isr") == 0).select(*keys, F.col("_id").alias(lid), F.col("_before").alias("_c"))
    lo, hi = (F.col("_c") - n + 1, F.col("_c")) if direction == "before" else (F.col("_c") + 1, F.col("_c") + n)
    at = at.withColumns({"_lo": F.greatest(lo, F.lit(1)), "_hi": hi})
    want = at.filter(F.col("_hi") >= F.col("_lo"))
    want = want.withColumn("_blk", F.explode(F.sequence(F.floor((F.col("_lo") - 1) / n), F.floor((F.col("_hi") - 1) / n))))
    met = with_null_keys(want, numbered.drop(rid), keys + ["_blk"]).filter(F.col("_pos").between(F.col("_lo"), F.col("_hi")))
    key = -F.col("_pos") if direction == "before" else F.col("_pos")
    packed = met.groupBy(*keys, lid).agg(F.sort_array(F.collect_list(F.struct(key.alias("_k"), *cols))).alias("_a"))

    def field(c):
        return F.transform("_a", lambda x: x[c]).alias(f"{c}_{direction}")

    packed = packed.select(*keys, lid, *[field(c) for c in cols])
    out = with_null_keys(left.select(*keys, lid), packed, keys + [lid], "left")
    return out.withColumns({f"{c}_{direction}": F.coalesce(F.col(f"{c}_{direction}"), F.array()) for c in cols})


def between_neighbors_join(left, right, keys, lid, lt, rt, rid, cols):
    """Pairs of a left row and each right row after the left row before it and before the left row after it.

    Right rows get the number of left rows before them; a left row numbered i meets
    the right rows numbered i - 1 and i. Left times are distinct per key.
    """
    keys = listed(keys)
    l = left.select(*keys, F.col(lt).alias("_t"), F.lit(1).alias("_s"), F.col(lid).alias("_id"), F.lit(1).alias("_isl"))
    r = right.select(*keys, F.col(rt).alias("_t"), F.lit(0).alias("_s"), F.col(rid).alias("_id"), F.lit(0).alias("_isl"))
    both = running(l.unionByName(r), keys, ["_t", "_s", "_id"], ["_isl"], ["sum"], names=lambda c, a: "_gap")
    gaps = both.filter(F.col("_isl") == 0).select(*keys, F.col("_id").alias(rid), F.col("_t").alias("_rt"), "_gap")
    lefts = both.filter(F.col("_isl") == 1).select(*keys, "_t", F.col("_id").alias(lid), "_gap")
    ahead = lambda d, ks: d.withColumn("_next", F.lead("_t").over(W.partitionBy(*ks).orderBy("_t", lid)))
    lefts = by_key(lefts, keys, ["_t", lid], ahead, after=1)
    lefts = lefts.withColumn("_gap", F.explode(F.array(F.col("_gap") - 1, F.col("_gap"))))
    met = with_null_keys(lefts, gaps, keys + ["_gap"]).filter(F.col("_next").isNull() | (F.col("_rt") < F.col("_next")))
    return with_null_keys(met.select(*keys, lid, rid), right.select(*keys, rid, *listed(cols)), keys + [rid])


def in_intervals(points, intervals, keys, time, pid, start="start", end="end"):
    """Points inside any interval of their key, both ends included: a sweep that counts open intervals."""
    keys = listed(keys)
    mark = lambda d, t, kind, delta, i: d.select(*keys, F.col(t).alias("_t"), F.lit(kind).alias("_s"), i.alias("_id"), F.lit(delta).alias("_d"))
    zero = F.lit(None).cast(points.schema[pid].dataType)
    whole = intervals.filter(F.col(start) <= F.col(end))
    first = whole.groupBy(*keys, start).agg(F.count(F.lit(1)).alias("_d"))
    last = whole.groupBy(*keys, end).agg((-F.count(F.lit(1))).alias("_d"))
    marks = (
        first.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_s"), zero.alias("_id"), "_d")
        .unionByName(last.select(*keys, F.col(end).alias("_t"), F.lit(2).alias("_s"), zero.alias("_id"), "_d"))
        .unionByName(points.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_s"), F.col(pid).alias("_id"), F.lit(0).cast("bigint").alias("_d")))
    )
    open_ = running(marks, keys, ["_t", "_s", "_id"], ["_d"], ["sum"], names=lambda c, a: "_open")
    inside = open_.filter((F.col("_s") == 1) & (F.col("_open") > 0)).select(*keys, F.col("_id").alias(pid))
    return same_keys(points, inside, keys + [pid], "left_semi")


def cross_keys(df, key, classes: dict[str, list[float]], event="event"):
    """Every key of the table with every class and each tolerance of the class."""
    pairs = [F.struct(F.lit(e).alias(event), F.lit(float(t)).alias("tolerance")) for e, ts in classes.items() for t in ts]
    return df.select(key).distinct().select(key, F.explode(F.array(*pairs)).alias("_p")).select(key, "_p.*")


UNMATCHED, MATCHED, OPEN, TRUTH = range(4)


def _match(times, truth, tol, lo=-np.inf, hi=np.inf):
    """(state of each detection, truths to keep) for detections in order of rank and truths in order of time.

    Rows below ``lo`` and from ``hi`` on are unknown, so a truth near an edge may be taken from there. A detection
    is decided if its nearest truth is surely free and nearer than an edge; else it stays open, and every truth
    that it may take counts as perhaps taken for all that rank below it. What is decided holds for any rows outside.
    """
    left, right = list(range(len(truth) + 1)), list(range(len(truth) + 1))
    taken, maybe = np.zeros(len(truth), bool), (truth - lo < tol) | (hi - truth < tol)

    def free(links, i):
        while links[i] != i:
            links[i] = links[links[i]]
            i = links[i]
        return i

    states = np.full(len(times), UNMATCHED)
    for d, (t, at) in enumerate(zip(times, np.searchsorted(truth, times, side="right"))):
        below, above = free(left, at) - 1, free(right, at)  # left is shifted by one: 0 stands for none
        edge = min(t - lo, hi - t)
        while True:
            gap_lo = t - truth[below] if below >= 0 else np.inf
            gap_hi = truth[above] - t if above < len(truth) else np.inf
            gap, i = (gap_lo, below) if gap_lo <= gap_hi else (gap_hi, above)
            if edge < tol and edge <= gap:
                states[d] = OPEN
            if not gap < tol:
                break
            if not maybe[i]:
                if states[d] == OPEN:
                    maybe[i] = True
                else:
                    states[d], taken[i] = MATCHED, True
                    left[i + 1], right[i] = i, i + 1
                break
            states[d] = OPEN
            if i == below:
                below = free(left, below) - 1
            else:
                above = free(right, above + 1)
    near = np.sort(times[states == OPEN])
    after = np.searchsorted(near, truth)
    padded = np.concatenate([[-np.inf], near, [np.inf]])
    wanted = np.minimum(truth - padded[after], padded[after + 1] - truth) < tol
    return states, ~taken & (wanted | (truth - lo < tol) | (hi - truth < tol))


def _match_runs(by, tolerance, batches):
    """Match piece by piece over a partition sorted by piece; the parts of a piece cut by batch ends are joined once, at its end."""
    held = []

    def ended():
        frame = pd.concat(held, ignore_index=True)
        held.clear()
        yield from _matched(frame, np.zeros(len(frame)), tolerance)

    for pdf in batches:
        if not len(pdf):
            continue
        ids = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
        now = tuple(pdf[by].iloc[0])
        if held and not all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(tuple(held[-1][by].iloc[-1]), now)):
            yield from ended()
        middle, last = ids < ids[-1], ids == ids[-1]
        if held:
            held.append(pdf[ids == ids[0]])
            if ids[0] == ids[-1]:
                continue
            yield from ended()
            middle &= ids > ids[0]
        yield from _matched(pdf[middle], ids[middle], tolerance)
        held.append(pdf[last])
    if held:
        yield from ended()


def _matched(pdf, ids, tolerance):
    if not len(pdf):
        return
    isd, t, tol, lo, hi = pdf["_isd"].to_numpy() == 1, *(pdf[c].to_numpy() for c in ("_t", tolerance, "_lo", "_hi"))
    best = np.lexsort((pdf["_id"].to_numpy(), -pdf["_score"].to_numpy()))
    rank = np.empty(len(best), int)
    rank[best] = np.arange(len(best))
    out = np.full(len(pdf), -1)
    edges = np.flatnonzero(np.diff(ids)) + 1
    for part in np.split(np.arange(len(pdf)), edges):
        d, g = part[isd[part]], part[~isd[part]]
        d, g = d[np.argsort(rank[d])], g[np.argsort(t[g], kind="stable")]
        out[d], kept = _match(t[d], t[g], tol[part[0]], lo[part[0]], hi[part[0]])
        out[g[kept]] = TRUTH
    yield pdf.assign(_state=out)[out >= 0].drop(columns=["_seg", "_lo", "_hi"])


def _pieces(runs, keys, tolerance, rows, shifted):
    """Runs with a piece number and the edges of the piece; runs of more than ``rows`` rows are cut into equal spans of time.

    A span is 64 tolerances at least. ``shifted`` moves the cuts by half a span, so that what was at an edge is now inside.
    """
    by = [*keys, "_run"]
    long = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_first"), F.max("_t").alias("_last")).filter(F.col("_n") > rows)
    x = with_null_keys(runs, long, by, "left")
    span = F.greatest(64 * F.col(tolerance), (F.col("_last") - F.col("_first")) * rows / F.col("_n"))
    start = F.col("_first") - (span / 2 if shifted else F.lit(0.0))
    x = x.withColumn("_seg", F.when(F.col("_n").isNull(), 0).otherwise(F.floor((F.col("_t") - start) / span)).cast("bigint"))
    margin = F.col(tolerance) / 100  # far above what rounding moves an edge by
    lo, hi = start + F.col("_seg") * span, start + (F.col("_seg") + 1) * span
    open_lo, open_hi = F.col("_n").isNull() | (lo <= F.col("_first")), F.col("_n").isNull() | (hi > F.col("_last") + margin)
    x = x.withColumns({
        "_lo": F.when(open_lo, F.lit(float("-inf"))).otherwise(lo + margin), "_hi": F.when(open_hi, F.lit(float("inf"))).otherwise(hi - margin)})
    return x.drop("_n", "_first", "_last")


def greedy_match(truths, dets, keys, time, score, did, tolerance="tolerance", rows=200_000):
    """Flag the detections that match a truth, one to one, in order of score within the keys and tolerance.

    A gap of at least the tolerance between neighbouring times separates what can
    match, so each key falls apart into runs. A run of more than ``rows`` rows is cut into
    pieces, matched apart as far as the rows beyond the cuts can't matter. The few rows left open around the
    cuts are matched in further rounds, with other cuts, until none is open; any cut gives the same result.
    Scores that fall along one long run hand their doubt from piece to piece: then as many rounds as pieces.
    """
    keys = listed(keys) + [tolerance]
    t = truths.select(*keys, F.col(time).cast("double").alias("_t"), F.lit(0).alias("_isd"), F.lit(0).cast("bigint").alias("_id"), F.lit(None).cast("double").alias("_score"))
    t = t.filter(F.col("_t").isNotNull())
    d = dets.filter(F.col(score).isNotNull() & F.col(time).isNotNull())
    d = d.select(*keys, F.col(time).cast("double").alias("_t"), F.lit(1).alias("_isd"), F.col(did).cast("bigint").alias("_id"), F.col(score).cast("double").alias("_score"))
    order = ["_t", "_isd", "_id"]

    def cut(x, ks):
        prev = F.lag("_t").over(W.partitionBy(*ks).orderBy(*order))
        return x.withColumn("_new", F.coalesce((F.col("_t") - prev >= F.col(tolerance)).cast("int"), F.lit(1)))

    both = t.unionByName(d)
    cuts = splitters(both, keys, order)
    runs = running(by_key(both, keys, order, cut, before=1, split=cuts), keys, order, ["_new"], ["sum"], split=cuts, names=lambda c, a: "_run")
    left = stored(runs.select(*keys, *order, "_score", "_run"))
    by = [*keys, "_run", "_seg"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields), "_state int"])
    done, rounds = [], 0
    while True:
        pieces = _pieces(left, keys, tolerance, rows, rounds % 2 == 1).select(*left.columns, "_seg", "_lo", "_hi")
        ready = pieces.repartition(*by).sortWithinPartitions(*by)
        out = stored(ready.mapInPandas(lambda batches: _match_runs(by, tolerance, batches), schema))
        done.append(out.filter(F.col("_state") <= MATCHED))
        if out.filter(F.col("_state") == OPEN).isEmpty():
            break
        left, rounds = out.filter(F.col("_state") >= OPEN).drop("_state"), rounds + 1
    out = reduce(DataFrame.unionByName, done)
    return out.select(*keys, F.col("_id").alias(did), F.col("_score").alias(score), (F.col("_state") == MATCHED).alias("matched"))


def complete_range(df, keys, step, width=1, pad=None):
    """Every step between the first and last of each key; ``pad`` columns are carried forward into the new rows."""
    keys = listed(keys)
    ends = df.groupBy(*keys).agg(F.min(step).alias("_lo"), F.max(step).alias("_hi"))
    span = width * 10_000  # spans first, so no array holds a whole key
    spans = ends.withColumn("_from", F.explode(F.sequence("_lo", "_hi", F.lit(span))))
    upto = F.least(F.col("_from") + span - width, F.col("_hi"))
    spine = spans.select(*keys, F.explode(F.sequence(F.col("_from"), upto, F.lit(width))).alias(step))
    out = same_keys(spine, df, keys + [step], "left")
    return fill(out, keys, step, pad) if pad else out


def snap_nearest(df, col, values, name=None):
    """Nearest of a few fixed values; ties go to the smaller."""
    near = [F.struct(F.abs(F.col(col) - F.lit(float(v))).alias("d"), F.lit(float(v)).alias("v")) for v in values]
    return df.withColumn(name or f"{col}_snapped", F.when(F.col(col).isNotNull(), F.array_min(F.array(*near))["v"]))
