"""Join of many rows to one row of facts per key, when a few keys may hold a large part of the rows.

The keys with at least one row in HOT of all rows are at most HOT keys, so their facts are broadcast; all
other keys meet in a shuffle, where none is large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

HOT = 1000


def looked_up(rows: DataFrame, facts: DataFrame, keys: Sequence[str], held: str, total: int) -> DataFrame:
    """``rows`` that have a fact, with its columns. ``facts`` has one row per key, none with a NULL key; its
    column ``held`` says how many of the ``total`` rows the key has. Both sides are read twice."""
    hot = F.broadcast(facts.filter(F.col(held) * HOT >= total))
    many = rows.join(hot, list(keys))
    few = rows.join(hot.select(*keys), list(keys), "left_anti").join(facts.filter(F.col(held) * HOT < total), list(keys))
    return many.unionByName(few)
