"""Fold assignment as a column, and time windows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ordered import attach, listed, positions, positions_all, same_keys
from .ranking import uniform

MAX_CLASSES = 1_000_000


def _hash(keys, seed):
    return F.xxhash64(*[F.col(c) for c in listed(keys)], F.lit(seed))


def stratified_fold(df, y, ids, k, seed=0, draw: Column | None = None, name="fold"):
    """k folds with the class shares of the table; rows are dealt in hash order per class."""
    y, ids = listed(y), listed(ids)
    d = df.withColumn("_h", _hash(ids, seed) if draw is None else draw)
    out = positions(d, y, ["_h", *ids], "_pos")
    return out.withColumn(name, ((F.col("_pos") - 1) % k).cast("int")).drop("_pos", "_h")


def multilabel_fold(df, labels, ids, k, seed=0, draw: Column | None = None, name="fold"):
    """Folds balanced over the values of each label: a row is dealt with the rows that share its rarest value.

    Rows are dealt in turn per rarest (label, value), in hash order or that of ``draw``, so each fold has the
    rows of a rare value in equal numbers, within one. Ties take the first label; NULL is a value.
    """
    labels, ids = listed(labels), listed(ids)
    d = df.withColumn("_h", _hash(ids, seed) if draw is None else draw)
    for j, c in enumerate(labels):
        d = same_keys(d, df.groupBy(c).agg(F.count(F.lit(1)).alias(f"_n{j}")), [c], "inner")
    each = [F.struct(F.col(f"_n{j}").alias("n"), F.lit(j).alias("j"), F.col(c).cast("string").alias("v")) for j, c in enumerate(labels)]
    d = d.withColumn("_rare", F.array_min(F.array(*each))).withColumns({"_rj": F.col("_rare.j"), "_rv": F.col("_rare.v")})
    out = positions(d, ["_rj", "_rv"], ["_h", *ids], "_pos")
    fold = ((F.col("_pos") - 1 + F.col("_rj")) % k).cast("int")
    return out.withColumn(name, fold).drop("_h", "_rare", "_rj", "_rv", "_pos", *[f"_n{j}" for j in range(len(labels))])


def _deal(classes: list[tuple[int, int]], k: int):
    """Largest first, each group to the lightest fold (the lowest number among equals).

    ``classes`` holds (group size, number of groups), largest first. Groups of one size go in at most 2 k phases:
    the folds within one group of the lightest take turns until they catch up with the next heavier fold. Gives
    per size its phases (first position, folds in turn), so the work depends on the distinct sizes only.
    """
    loads = [0] * k
    for size, count in classes:
        phases, at = [], 0
        while at < count:
            order = sorted((load, i) for i, load in enumerate(loads))
            turn = [i for load, i in order if load < order[0][0] + size]
            room = count - at
            if len(turn) < k:
                ahead, fold = order[len(turn)]  # joins once the others pass it
                room = min(room, sum((ahead - loads[i]) // size + ((ahead - loads[i]) % size > 0 or i < fold) for i in turn))
            phases.append((at, turn))
            for t, i in enumerate(turn):
                loads[i] += size * (room // len(turn) + (t < room % len(turn)))
            at += room
        yield size, phases


def group_fold(df, group, k, strata: Column | None = None, name="fold"):
    """k folds that keep groups whole and balance rows: the largest group first, to the lightest fold.

    ``strata`` is an aggregate per group with few values; each is dealt on its own. The driver sees one row
    per stratum and distinct group size, at most about sqrt(2 x rows) sizes a stratum, and 2 k phases for each.
    """
    group = listed(group)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), (F.lit(0) if strata is None else strata).alias("_st"))
    counted: dict = {}
    found = sizes.groupBy("_st", "_n").agg(F.count(F.lit(1)).alias("c")).limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} strata and group sizes")
    for r in found:
        counted.setdefault(r["_st"], []).append((r["_n"], r["c"]))
    rows = [(st, n, phases) for st, cl in counted.items() for n, phases in _deal(sorted(cl, reverse=True), k)]
    kind = sizes.schema["_st"].dataType.simpleString()
    plan = df.sparkSession.createDataFrame(rows, f"_st {kind}, _n bigint, _phases array<struct<first:bigint,turn:array<int>>>")
    at = positions(sizes, ["_st", "_n"], group, "_pos")
    plan = F.broadcast(plan) if len(rows) <= 100_000 else plan
    at = same_keys(at, plan, ["_st", "_n"], "inner").withColumn("_i", F.col("_pos") - 1)
    at = at.withColumn("_phase", F.element_at(F.filter("_phases", lambda p: p["first"] <= F.col("_i")), -1))
    fold = F.get("_phase.turn", ((F.col("_i") - F.col("_phase.first")) % F.size("_phase.turn")).cast("int"))
    return same_keys(df, at.select(*group, fold.alias(name)), group, "left")


def stratified_group_fold(df, y, group, k, name="fold"):
    """Whole groups, dealt within strata of the rounded group mean of the target."""
    return group_fold(df, group, k, F.bround(F.avg(y)).cast("int"), name)


def _parts(df, windows):
    """One row per (row, fold, part) for windows given as (fold, part, condition); a row may lie in several."""
    parts = [F.when(cond, F.struct(F.lit(fold).alias("fold"), F.lit(part).alias("part"))) for fold, part, cond in windows]
    return df.withColumn("_p", F.explode(F.array_compact(F.array(*parts)))).select("*", "_p.*").drop("_p")


def sliding_split(df, ts, n, test_days=7, train_days=35):
    """n folds going back from the last day by ``test_days`` each.

    Both windows span ``train_days + test_days`` days: ``train`` ends where the last
    ``test_days`` of ``test`` begin, so each holds its history and its label days.
    """
    last = df.agg(F.max(F.to_date(ts)).alias("_last"))  # one row
    out, back = df.transform(attach, last), F.datediff("_last", F.to_date(ts))
    span, windows = train_days + test_days, []
    for i in range(n):
        for part, end in (("test", i * test_days), ("train", (i + 1) * test_days)):
            windows.append((i, part, (back >= end) & (back < end + span)))
    return _parts(out, windows).drop("_last")


def stepped_split(df, ts, n, train_days, test_days):
    """n train/test windows whose starts are spread evenly over the span of the table; starts included."""
    ends = df.agg(F.unix_seconds(F.min(ts).cast("timestamp")).alias("_lo"), F.unix_seconds(F.max(ts).cast("timestamp")).alias("_hi"))
    out, sec = df.transform(attach, ends), F.unix_seconds(F.col(ts).cast("timestamp")) - F.col("_lo")
    train, test = train_days * 86_400, test_days * 86_400
    step = (F.col("_hi") - F.col("_lo") - (train + test)) / (n - 1)
    windows = []
    for i in range(n):
        start = step * i
        windows.append((i, "train", (sec >= start) & (sec < start + train)))
        windows.append((i, "test", (sec >= start + train) & (sec < start + train + test)))
    return _parts(out, windows).drop("_lo", "_hi")


def range_split(df, ts, ranges: dict[str, tuple[str, str]], name="part"):
    """Label rows by fixed date ranges, start included and end excluded; others are dropped."""
    label = F.lit(None).cast("string")
    for part, (start, end) in ranges.items():
        hit = (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
        label = F.when(hit, F.lit(part)).otherwise(label)
    return df.withColumn(name, label).filter(F.col(name).isNotNull())


def holdout_last(df, step, n, name="part"):
    """The last n steps (days for a date) as valid, the rest as train."""
    last = df.agg(F.max(step).alias("_last"))
    is_date = df.schema[step].dataType.typeName() in ("date", "timestamp", "timestamp_ntz")
    back = F.datediff("_last", step) if is_date else F.col("_last") - F.col(step)
    return df.transform(attach, last).withColumn(name, F.when(back < n, "valid").otherwise("train")).drop("_last")


def label_window(df, ts, cut, days, keys):
    """Rows up to the cut as features and rows of the next ``days`` as labels, of the keys that have labels."""
    day, at = F.to_date(ts), F.lit(cut).cast("date")
    part = F.when(day <= at, "feature").when(day <= F.date_add(at, days), "label")
    d = df.withColumn("part", part).filter(F.col("part").isNotNull())
    labelled = d.filter(F.col("part") == "label").select(*listed(keys)).distinct()
    return d.join(labelled, listed(keys), "left_semi")


def beta_draw(u: Column, a: float, b: float, points: int = 256) -> Column:
    """A Beta(a, b) value from a uniform one, by linear interpolation in a table of its inverse."""
    import numpy as np

    x = np.linspace(0, 1, 20_001)
    dens = np.where((x > 0) & (x < 1), x ** (a - 1) * (1 - x) ** (b - 1), 0.0)
    cum = np.concatenate([[0], np.cumsum((dens[1:] + dens[:-1]) / 2)])
    table = np.interp(np.linspace(0, 1, points + 1), cum / cum[-1], x)
    arr = F.array(*[F.lit(float(v)) for v in table])
    i = F.least(F.floor(u * points), F.lit(points - 1)).cast("int")
    return F.get(arr, i) + (F.get(arr, i + 1) - F.get(arr, i)) * (u * points - i)


def virtual_time(df, keys, ts, seed=0, beta=(2.2, 2.3), draw: Column | None = None, name="virtual_ts"):
    """Shift each key's clock by a random share of the time left between its last row and the table's last."""
    keys = listed(keys)
    share = beta_draw(uniform(keys, seed), *beta) if draw is None else draw
    last = df.groupBy(*keys).agg(F.max(ts).alias("_own"))
    latest = df.agg(F.max(ts).alias("_all"))
    moved = last.transform(attach, latest).select(*keys, F.floor((F.col("_all") - F.col("_own")) * share).alias("_shift"))
    return same_keys(df, moved, keys, "inner").withColumn(name, F.col(ts) + F.col("_shift")).drop("_shift")


def tail_folds(df, order, n_eval, n_valid, k, name="part"):
    """The last rows in order as ``eval``, the k blocks before them as ``valid_0``.. (latest first), the rest as ``train``."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    out = positions_all(df, order, "_pos").transform(attach, total).withColumn("_back", F.col("_n") - F.col("_pos"))
    block = F.floor((F.col("_back") - n_eval) / n_valid)
    part = F.when(F.col("_back") < n_eval, "eval").when(block < k, F.concat(F.lit("valid_"), block.cast("string"))).otherwise("train")
    return out.withColumn(name, part).drop("_pos", "_n", "_back")


def stage_label(col, edges: dict[str, int]) -> Column:
    """Stage of a level: the first stage whose upper level is not exceeded."""
    out = F.lit(None).cast("string")
    for label, top in sorted(edges.items(), key=lambda kv: -kv[1]):
        out = F.when(F.col(col) <= top, F.lit(label)).otherwise(out)
    return out
