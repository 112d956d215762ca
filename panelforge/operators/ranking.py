"""Top-k, list votes and deterministic sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window as W, functions as F

from ..session import stored
from .ordered import attach, listed, positions_all, same_keys


CELLS = 1 << 14


def top_values(df, col, n):
    """The n most frequent values; ties go to the smaller value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col).limit(n)


def top_rows(df, keys, n, *order):
    """First n rows per key in the order, with their ``rank``; the limit applies before the shuffle."""
    w = W.partitionBy(*listed(keys)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_values_by(df, keys, col, n):
    """The n most frequent values per key."""
    keys = listed(keys)
    counted = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("count"))
    return top_rows(counted, keys, n, F.desc("count"), F.col(col))


def topk_list(df, keys, score, item, n, name="items"):
    """Array of the n best items per key, best first; ties go to the smaller item."""
    keys = listed(keys)
    best = top_rows(df.select(*keys, score, item), keys, n, F.desc(score), F.col(item))
    listed_ = F.transform(F.sort_array(F.collect_list(F.struct("rank", item))), lambda x: x[item])
    return best.groupBy(*keys).agg(listed_.alias(name))


def vote_lists(lists, weights, n) -> Column:
    """Merge ranked lists of one row: items by the summed weight of the lists that hold
    them, the earlier seen first among equals, cut to n."""
    total = float(sum(weights))
    given = [F.coalesce(F.col(c), F.array()) for c in lists]
    seen = F.array_distinct(F.concat(*given))
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    score = lambda x: reduce(lambda p, q: p + q, [count(a, x) * (w / total) for a, w in zip(given, weights)])
    scored = F.transform(seen, lambda x, i: F.struct((-score(x)).alias("s"), i.alias("i"), x.alias("x")))
    return F.slice(F.transform(F.array_sort(scored), lambda v: v["x"]), 1, n)


def fallback_list(own, default, n) -> Column:
    """The row's list, then the default list, without repeats, cut to n."""
    return F.slice(F.array_distinct(F.concat(F.coalesce(own, F.array()), default)), 1, n)


def uniform(cols, seed=0) -> Column:
    """Repeatable number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in listed(cols)], F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def sample_by_key(df, keys, lo, hi, seed=0, draw: Column | None = None):
    """All rows of the keys whose number lies in [lo, hi); one number per key."""
    u = uniform(keys, seed) if draw is None else draw
    return df.filter((u >= lo) & (u < hi))


def shuffle(df, keys, seed=0):
    """Rows in a repeatable random order."""
    return df.orderBy(F.xxhash64(*[F.col(c) for c in listed(keys)], F.lit(seed)), *listed(keys))


def sample(df, keys, n, seed=0, draw: Column | None = None):
    """n rows, those with the smallest hash (or finite ``draw``; NULL first), ties to the smaller keys; all if fewer.

    Counts of the hash in equal cells show the cell in which the n-th row lies. Rows of the cells before stay
    without a shuffle; only those of that cell are ordered, over many tasks.
    """
    if n <= 0:
        return df.limit(0)
    keys = listed(keys)
    h = F.xxhash64(*[F.col(c) for c in keys], F.lit(seed)) if draw is None else draw
    drawn = df.withColumn("_h", h)
    lo, hi = (-(2.0**63), 2.0**63) if draw is None else drawn.agg(F.min("_h").cast("double"), F.max("_h").cast("double")).first()
    width = ((hi or 0.0) - (lo or 0.0)) / CELLS or 1.0
    placed = drawn.withColumn("_cell", F.coalesce(F.floor((F.col("_h").cast("double") - F.lit(lo or 0.0)) / width), F.lit(-1)).cast("int"))
    counted = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_c"))  # at most CELLS + 2 rows
    total = counted.withColumn("_upto", F.sum("_c").over(W.orderBy("_cell")))
    edge = total.filter(F.col("_upto") >= n).agg(F.min(F.struct("_cell", (n - F.col("_upto") + F.col("_c")).alias("left"))).alias("e")).first()["e"]
    if edge is None:
        return df
    inside = placed.filter(F.col("_cell") < edge["_cell"]).drop("_h", "_cell")
    last = positions_all(placed.filter(F.col("_cell") == edge["_cell"]).drop("_cell"), ["_h", *keys], "_pos")
    return inside.unionByName(last.filter(F.col("_pos") <= edge["left"]).drop("_h", "_pos"))


def batches(df, order, size, name="batch"):
    """Number of the fixed-size batch each row falls in, by order, from 0."""
    out = positions_all(df, order, "_pos")
    return out.withColumn(name, F.floor((F.col("_pos") - 1) / size)).drop("_pos")


PRIME = 2_147_483_647
SPAN = 10_000


def negative_samples(pos, user, item, n, popular=None, n_popular=0, seed=0, draw: Column | None = None):
    """Per user n items it has no row with, from all items, and n_popular from the most frequent ``popular``.

    Item positions are walked from a user-dependent start in steps coprime to the
    item count, so candidates of a user never repeat; a user with p items draws
    n + p candidates, which leaves n after the anti join (or all there are).
    ``draw`` is a whole number per user; a hash with the seed if not given.
    """
    own = stored(pos.groupBy(user, item).agg(F.count(F.lit(1)).alias("_c")))  # read several times below
    counted = own.groupBy(item).agg(F.sum("_c").alias("_c"))
    ranked = positions_all(counted.withColumn("_neg", -F.col("_c")), ["_neg", item], "_slot").select(item, (F.col("_slot") - 1).alias("_slot"))
    ranked = stored(ranked)
    start = F.xxhash64(F.col(user), F.lit(seed)) if draw is None else draw
    users = own.groupBy(user).agg(F.count(F.lit(1)).alias("_own")).withColumn("_start", F.pmod(start, F.lit(PRIME)))

    def drawn(items, want):
        size = items.agg(F.count(F.lit(1)).alias("_size"))  # one row
        tries = F.least(F.col("_size"), F.lit(want) + F.col("_own"))
        spans = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((tries - 1) / SPAN)))  # no array of all tries
        walk = users.transform(attach, size).withColumn("_tries", tries).filter("_tries > 0").withColumn("_span", spans)
        walk = walk.withColumn("_try", F.explode(F.sequence(F.col("_span") * SPAN + 1, F.least("_tries", (F.col("_span") + 1) * SPAN))))
        walk = walk.withColumn("_slot", F.pmod(F.col("_start") + F.col("_try") * F.lit(PRIME), F.col("_size")))
        found = walk.join(items, "_slot").join(own.select(user, item), [user, item], "left_anti")
        return top_rows(found, user, want, F.col("_try")).select(user, item)

    out = drawn(ranked, n)
    if n_popular:
        out = out.unionByName(drawn(ranked.filter(F.col("_slot") < popular), n_popular)).distinct()
    return out
