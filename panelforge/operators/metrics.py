"""Evaluation metrics as aggregations; running totals over the whole table go through ``ordered``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import correlation
from ..session import stored
from .aggregates import hierarchy_sum, series_scale
from .joins import cross_keys, greedy_match, in_intervals
from .ordered import attach, listed, running, running_all, same_keys
from .reshape import to_intervals


def _by(df, by, *aggs):
    return df.groupBy(*listed(by)).agg(*aggs) if by else df.agg(*aggs)


def rmse(df, y, p, by=None):
    return _by(df, by, F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2))).alias("rmse"))


def mcrmse(df, pairs):
    """Mean of the root mean squared errors of several target columns."""
    each = [F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2))) for y, p in pairs]
    return df.agg((sum(each[1:], each[0]) / len(each)).alias("mcrmse"))


def rmsle(df, y, p, w=None, by=None):
    weight = F.lit(1.0) if w is None else F.col(w)
    return _by(df, by, F.sqrt(F.sum(weight * F.pow(F.log1p(y) - F.log1p(p), 2)) / F.sum(weight)).alias("rmsle"))


def smape_row(y, p):
    """Symmetric percentage error of a row, 0 for 0 against 0."""
    base = (F.abs(F.col(y)) + F.abs(F.col(p))) / 2
    return F.when(base == 0, 0.0).otherwise(F.abs(F.col(y) - F.col(p)) / base) * 100


def smape(df, y, p, by=None):
    return _by(df, by, F.avg(smape_row(y, p)).alias("smape"))


def weighted_corr(df, y, p, w=None, by=None):
    """Weighted Pearson correlation; unweighted without ``w``."""
    if w is None:
        return _by(df, by, correlation(y, p).alias("corr"))
    a, b, v = F.col(y), F.col(p), F.col(w)
    s = _by(
        df, by, F.sum(v).alias("_w"), F.sum(a * v).alias("_a"), F.sum(b * v).alias("_b"),
        F.sum(a * a * v).alias("_aa"), F.sum(b * b * v).alias("_bb"), F.sum(a * b * v).alias("_ab"),
    )
    m = lambda c: F.col(c) / F.col("_w")
    cov = m("_ab") - m("_a") * m("_b")
    r = F.try_divide(cov, F.sqrt((m("_aa") - m("_a") * m("_a")) * (m("_bb") - m("_b") * m("_b"))))
    return s.select(*listed(by or []), r.alias("corr"))


def auc(df, y, p):
    """Area under the ROC curve; equal scores count half. Rows are first counted per score."""
    per = df.groupBy(F.col(p).alias("_p")).agg(F.sum(F.col(y)).cast("double").alias("_pos"), F.sum(1 - F.col(y)).cast("double").alias("_neg"))
    run = running_all(per, ["_p"], ["_neg"], ["sum"], names=lambda c, a: "_cum")
    area = F.sum(F.col("_pos") * (F.col("_cum") - F.col("_neg") / 2))
    return run.agg(F.try_divide(area, F.sum("_pos") * F.sum("_neg")).alias("auc"))


def gini_capture(df, y, p, rid, neg_w=20, top=0.04):
    """Half the sum of the normalized weighted Gini and the share of positives within the top weight.

    Negatives weigh ``neg_w``. Equal predictions go by ``rid``.
    """
    d = df.select(F.col(y).cast("double").alias("_y"), (-F.col(p)).alias("_o"), F.col(rid).alias("_id"))
    d = d.withColumn("_w", F.when(F.col("_y") == 0, float(neg_w)).otherwise(1.0)).withColumn("_yw", F.col("_y") * F.col("_w"))
    d = running_all(d, ["_o", "_id"], ["_w", "_yw"], ["sum"], names=lambda c, a: f"_c{c}")
    totals = d.agg(F.sum("_w").alias("_all"), F.sum("_yw").alias("_found"), F.sum("_y").alias("_n"), F.sum(1 - F.col("_y")).alias("_m"))
    d = d.transform(attach, totals)
    found = F.sum(F.when(F.col("_c_w") <= F.floor(F.lit(top) * F.col("_all")), F.col("_y")).otherwise(0.0))
    gini = F.sum((F.col("_c_yw") / F.col("_found") - F.col("_c_w") / F.col("_all")) * F.col("_w"))
    s = d.groupBy("_all", "_found", "_n", "_m").agg(found.alias("_f"), gini.alias("_g"))
    n, m, w = F.col("_n"), F.col("_m"), F.col("_all")
    # the best order has all positives first: an arithmetic series
    ideal = (1 / n - 1 / w) * n * (n + 1) / 2 + neg_w * (m - (m * n + neg_w * m * (m + 1) / 2) / w)
    return s.select((0.5 * (F.col("_g") / ideal + F.col("_f") / n)).alias("score"))


def map_at_k(df, pred, target, k=12):
    """Mean average precision of ranked lists against lists of wanted items; repeats count once."""
    first = lambda i: F.col(pred)[i].isNotNull() & F.array_contains(F.col(target), F.col(pred)[i]) & (
        F.array_position(F.col(pred), F.col(pred)[i]) == i + 1
    )
    places = F.sequence(F.lit(0), F.least(F.size(pred), F.lit(k)) - 1)
    zero = F.struct(F.lit(0.0).alias("hits"), F.lit(0.0).alias("score"))

    def step(a, i):
        hit = first(i).cast("double")
        return F.struct((a["hits"] + hit).alias("hits"), (a["score"] + hit * (a["hits"] + hit) / (i + 1)).alias("score"))

    score = F.when(F.size(pred) > 0, F.aggregate(places, zero, step)["score"]).otherwise(0.0)
    return df.agg(F.avg(score / F.least(F.size(target), F.lit(k))).alias("map"))


def pr_area(df, keys, matched, score, positives):
    """Average precision per key: precision times the gain in recall at each distinct score."""
    keys = listed(keys)
    hit = F.col(matched).cast("int")
    per = df.groupBy(*keys, score).agg(F.sum(hit).alias("_tp"), F.sum(1 - hit).alias("_fp")).withColumn("_o", -F.col(score))
    run = running(per, keys, ["_o"], ["_tp", "_fp"], ["sum"], names=lambda c, a: f"_c{c}")
    gain = F.col("_tp") * F.col("_c_tp") / (F.col("_c_tp") + F.col("_c_fp"))
    area = run.groupBy(*keys).agg(F.sum(gain).alias("_a"))
    shared = [c for c in positives.columns if c in keys]
    return same_keys(area, positives, shared, "inner").select(*keys, (F.col("_a") / F.col("_p")).alias("ap"))


def event_ap_table(truth, dets, tolerances, video="video_id", time="time", event="event", score="score", did="det_id"):
    """Average precision per event class and tolerance.

    ``truth`` also holds start and end marks; detections outside all closed
    start-end intervals are left out, the rest is matched one to one.
    """
    iv = to_intervals(truth, video, [time], event, time)
    facts = truth.filter(~F.col(event).isin("start", "end")).select(video, event, time)
    dets = stored(in_intervals(dets, iv, video, time, did))
    grid = cross_keys(facts, video, tolerances, event)
    t = facts.join(grid, [video, event])
    d = dets.join(grid, [video, event])
    matched = greedy_match(t, d, [video, event], time, score, did)
    return pr_area(matched, [event, "tolerance"], "matched", score, facts.groupBy(event).agg(F.count(F.lit(1)).alias("_p")))


def event_ap(truth, dets, tolerances, **names):
    """Mean over the event classes of the mean average precision over their tolerances."""
    event = names.get("event", "event")
    per = event_ap_table(truth, dets, tolerances, **names).groupBy(event).agg(F.avg("ap").alias("ap"))
    return per.agg(F.avg("ap").alias("event_ap"))


def f1_table(df, y, p, by=None, n=100):
    """Macro F1 at n thresholds spread over 0..1.

    Rows are counted by the number of thresholds they reach, so each is touched once
    and only n + 1 counts per group go on.
    """
    by = listed(by or [])
    at = F.floor(F.col(p) * (n - 1))
    th = lambda j: j / F.lit(float(n - 1))
    at = F.when(th(at) > F.col(p), at - 1).when(th(at + 1) <= F.col(p), at + 1).otherwise(at)
    reach = F.greatest(F.least(at, F.lit(n - 1)), F.lit(-1))
    per = df.groupBy(*by, reach.alias("_j")).agg(F.sum(F.col(y)).cast("double").alias("_pos"), F.count(F.lit(1)).cast("double").alias("_n"))
    sums = per.groupBy(*by).agg(F.collect_list(F.struct("_j", "_pos", "_n")).alias("_b"), F.sum("_pos").alias("_P"), F.sum("_n").alias("_N"))
    sums = sums.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    up = lambda f: F.aggregate("_b", F.lit(0.0), lambda s, x: s + F.when(x["_j"] >= F.col("_t"), x[f]).otherwise(0.0))
    sums = sums.withColumns({"_tp": up("_pos"), "_pp": up("_n")})
    f1 = lambda tp, actual, called: F.when(actual + called == 0, 0.0).otherwise(2 * tp / (actual + called))
    tn = F.col("_N") - F.col("_pp") - F.col("_P") + F.col("_tp")
    macro = (f1(F.col("_tp"), F.col("_P"), F.col("_pp")) + f1(tn, F.col("_N") - F.col("_P"), F.col("_N") - F.col("_pp"))) / 2
    return sums.select(*by, th(F.col("_t")).alias("threshold"), macro.alias("f1"))


def best_f1(df, y, p, by=None, n=100):
    """Best macro F1 and the lowest threshold that reaches it."""
    best = F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("t"))).alias("_b")
    return _by(f1_table(df, y, p, by, n), by, best).select(*listed(by or []), F.col("_b.f1").alias("f1"), (-F.col("_b.t")).alias("threshold"))


def wrmsse_table(train, valid, levels, step, y, p, revenue, split=None):
    """Scaled error and weight per series of every level.

    ``train`` and ``valid`` are long with the level columns and ``step``; ``revenue``
    has the level columns and a value whose shares are the weights. The scale is the
    mean squared step of the series after its leading zeros (1 if that is 0).
    """
    dims = list(dict.fromkeys(c for cols in levels.values() for c in cols))
    timed = {name: [*cols, step] for name, cols in levels.items()}
    key = ["level", *dims]
    none = F.lit(None).cast("double")

    def part(df, at, past=none, true=none, guess=none, value=none, is_past=0, is_ahead=0):
        held = {"_past": past, "_y": true, "_p": guess, "_v": value, "_is_past": F.lit(is_past), "_is_ahead": F.lit(is_ahead)}
        return df.select(*dims, at.alias(step), *[c.cast("double").alias(n) for n, c in held.items()])

    rows = part(train, F.col(step), past=F.col(y), is_past=1)
    rows = rows.unionByName(part(valid, F.col(step), true=F.col(y), guess=F.col(p), is_ahead=1))
    rows = rows.unionByName(part(revenue, F.lit(None).cast(train.schema[step].dataType), value=F.col("value")))
    names = ("_past", "_y", "_p", "_v", "_is_past", "_is_ahead")
    rolled = stored(hierarchy_sum(rows, timed, {n: n for n in names}))  # one expansion over the levels for all three
    scale = series_scale(rolled.filter("_is_past > 0").select(*key, step, "_past"), key, [step], "_past", split=split)
    err = rolled.filter("_is_ahead > 0").groupBy(*key).agg(F.avg(F.pow(F.col("_y") - F.col("_p"), 2)).alias("_mse"))
    sums = rolled.filter(F.col("_v").isNotNull()).select(*key, "_v")
    totals = sums.groupBy("level").agg(F.sum("_v").alias("_t"))  # one row per level
    weights = sums.join(F.broadcast(totals), "level").select(*key, (F.col("_v") / F.col("_t") / len(levels)).alias("weight"))
    both = same_keys(same_keys(err, scale, key, "left"), weights, key, "inner")
    # a series without a step has no scale and, like one with scale 0, is divided by 1
    scaled = F.sqrt(F.col("_mse") / F.when(F.coalesce("scale", F.lit(0.0)) != 0, F.col("scale")).otherwise(1.0))
    return both.select(*key, scaled.alias("rmsse"), "weight")


def wrmsse(train, valid, levels, step, y, p, revenue):
    """Weighted sum of the scaled errors over all series and levels."""
    return wrmsse_table(train, valid, levels, step, y, p, revenue).agg(F.sum(F.col("rmsse") * F.col("weight")).alias("wrmsse"))


def position_error(df, x, y, floor, px, py, pfloor, penalty=15.0):
    """Mean of |dx| + |dy| + penalty x |dfloor|."""
    d = lambda a, b: F.abs(F.col(a) - F.col(b))
    return df.agg(F.avg(d(x, px) + d(y, py) + penalty * d(floor, pfloor)).alias("position_error"))


def mse(df, y, p, by=None):
    return _by(df, by, F.avg(F.pow(F.col(y) - F.col(p), 2)).alias("mse"))


def log_loss(df, y, p, by=None, eps=1e-15):
    q = F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps))
    return _by(df, by, (-F.avg(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("log_loss"))


def validate_batch(pred: DataFrame, expected: DataFrame, rid):
    """Row counts of both, ids found on one side only, ids predicted more than once."""
    a = pred.groupBy(rid).agg(F.count(F.lit(1)).alias("_a"))
    b = expected.groupBy(rid).agg(F.count(F.lit(1)).alias("_b"))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return a.join(b, rid, "full").agg(
        z("_a").alias("predicted"), z("_b").alias("expected"), F.count_if(F.col("_a").isNull()).alias("missing"),
        F.count_if(F.col("_b").isNull()).alias("unexpected"), F.count_if(F.col("_a") > 1).alias("repeated"),
    )
