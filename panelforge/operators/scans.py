"""Recurrences along ordered keys that no window function expresses, for keys of any size.

Rows are sorted by key, segment and order; a task then runs through them with a state of a few numbers, so
nothing of a key is held. Large keys are cut at the splitters of ``ordered``, and what one segment leaves behind is
handed to the next: for an affine recurrence in one step, as maps compose; for a state machine in rounds, in
which only segments whose entry state has changed run again. Any cut gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import stored
from .ordered import AUTO, SEG, _chosen, _cold, _located, listed, same_keys

NEW = "_new"


def _segments(df: DataFrame, keys: list[str], order: list[str], split) -> tuple[DataFrame, bool]:
    """``df`` with the segment of each row, and whether any key has more than one."""
    sp = _chosen(df, keys, order, split)
    if sp is None:
        return df.withColumn(SEG, F.lit(0)), False
    return _cold(df, keys, sp).withColumn(SEG, F.lit(0)).unionByName(_located(df, keys, order, sp)), True


def _sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of each key and segment together and in order, the first of each marked."""
    w = W.partitionBy(*keys, SEG).orderBy(*order)
    return df.withColumn(NEW, F.lag(F.lit(1)).over(w).isNull())


def _with(schema: T.StructType, added: str) -> T.StructType:
    return T.StructType([f for f in schema.fields] + T.StructType.fromDDL(added).fields)


def affine(df: DataFrame, keys, order, a: Column, b: Column, name: str, split=AUTO) -> DataFrame:
    """Add y = a y' + b, with y' that of the row before in the key.

    A row with NULL in ``a`` or ``b`` takes over y'. Before the first row y' is NULL, so y is NULL until a row
    with a = 0 sets it to b.
    """
    keys, order = listed(keys), listed(order)
    known = a.isNotNull() & b.isNotNull()
    start = df.withColumns({"_a": F.when(known, a).otherwise(1.0).cast("double"), "_b": F.when(known, b).otherwise(0.0).cast("double")})
    cut, many = _segments(start, keys, order, split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q, held = 1.0, 0.0, False  # the map from before the segment to here; held: some a was 0, so that before does not matter
        for batch in batches:
            ps, qs, hs = [], [], []
            for new, x, y in zip(*[batch.column(c).to_pylist() for c in (NEW, "_a", "_b")]):
                if new:
                    p, q, held = 1.0, 0.0, False
                if x == 0:
                    p, q, held = 0.0, y, True
                else:
                    p, q = p * x, q * x + y
                ps.append(p), qs.append(q), hs.append(held)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ps, pa.float64()), pa.array(qs, pa.float64()), pa.array(hs, pa.bool_())], [*batch.schema.names, "_p", "_q", "_set"])

    ready = _sorted(cut, keys, order)
    mapped = ready.mapInArrow(run, _with(ready.schema, "_p double, _q double, _set boolean"))
    if not many:
        return mapped.withColumn(name, F.when(F.col("_set"), F.col("_q"))).select(*df.columns, name)
    mapped = stored(mapped)
    # one map per segment: that of its last row
    ends = mapped.groupBy(*keys, SEG).agg(F.max_by(F.struct("_p", "_q", "_set"), F.struct(*order)).alias("m"))
    ranked = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(SEG, "m"))).alias("ms"))

    def on(state, s):
        m, y = s["m"], state["y"]
        after = F.when(m["_set"], m["_q"]).otherwise(m["_p"] * y + m["_q"])
        entry = F.array(F.struct(s[SEG].alias(SEG), y.alias("_y")))
        return F.struct(after.alias("y"), F.concat(state["out"], entry).alias("out"))

    none = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast(f"array<struct<{SEG}:int,_y:double>>").alias("out"))
    entry = ranked.select(*keys, F.explode(F.aggregate("ms", none, on, lambda s: s["out"])).alias("e")).select(*keys, f"e.{SEG}", "e._y")
    met = same_keys(mapped, F.broadcast(entry), keys + [SEG], "inner")
    return met.withColumn(name, F.when(F.col("_set"), F.col("_q")).otherwise(F.col("_p") * F.col("_y") + F.col("_q"))).select(*df.columns, name)


def machine(df: DataFrame, keys, order, cols: Sequence[str], step: Callable, state: str, out: str, split=AUTO) -> DataFrame:
    """Add the columns ``out`` of a state machine: ``step(state, values) -> (state, outputs)`` for each row in order.

    ``state`` and ``out`` are DDL of a few columns; ``values`` are those of ``cols``. The state before a key's first row
    is None. ``step`` must depend on its arguments only.
    """
    keys, order, cols = listed(keys), listed(order), list(cols)
    cut, many = _segments(df, keys, order, split)
    kept = T.StructType.fromDDL(state)
    fields = kept.fieldNames()

    def runner(rows_out: bool):
        made = T.StructType.fromDDL(out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, last = None, None
            for batch in batches:
                rows, ended = [], []
                columns = [batch.column(c).to_pylist() for c in cols]
                entries = batch.column("_entry").to_pylist() if "_entry" in batch.schema.names else [None] * batch.num_rows
                for i, (new, entry, *values) in enumerate(zip(batch.column(NEW).to_pylist(), entries, *columns)):
                    if new:
                        now = None if entry is None else tuple(entry[f] for f in fields)
                    now, got = step(now, values)
                    rows.append(got)
                    ended.append(now)
                if rows_out:
                    arrays = [pa.array([r[i] for r in rows], type=_arrow(f)) for i, f in enumerate(made)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *made.fieldNames()])
                else:
                    exits = pa.array([None if s is None else dict(zip(fields, s)) for s in ended], type=pa.struct([pa.field(f.name, _arrow(f)) for f in kept]))
                    yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (*keys, SEG, *order)], exits], [*keys, SEG, *order, "_exit"])

        return run

    if not many:
        ready = _sorted(cut, keys, order)
        return ready.mapInArrow(runner(True), _with(ready.schema, out)).drop(SEG, NEW)
    cut = stored(cut)
    narrow = cut.select(*dict.fromkeys([*keys, SEG, *order, *cols]))
    # entry states, one row per segment; a segment runs again only if its entry state changed
    entries = stored(narrow.select(*keys, SEG).distinct().withColumn("_entry", F.lit(None).cast(kept)))
    changed = entries
    exits = None
    while True:
        ready = _sorted(same_keys(narrow, F.broadcast(changed), keys + [SEG], "inner"), keys, order)
        types = T.StructType([ready.schema[c] for c in (*keys, SEG, *order)] + [T.StructField("_exit", kept)])
        fresh = ready.mapInArrow(runner(False), types).groupBy(*keys, SEG).agg(F.max_by("_exit", F.struct(*order)).alias("_exit"))
        if exits is not None:
            old = same_keys(exits, changed.select(*keys, SEG), keys + [SEG], "left_anti")
            fresh = fresh.unionByName(old)
        exits = stored(fresh)
        w = W.partitionBy(*keys).orderBy(SEG)
        handed = exits.select(*keys, SEG, F.lag("_exit").over(w).alias("_handed"))
        compared = stored(same_keys(entries, handed, keys + [SEG], "inner"))
        entries = compared.select(*keys, SEG, F.col("_handed").alias("_entry"))
        changed = compared.filter(~F.col("_entry").eqNullSafe(F.col("_handed"))).select(*keys, SEG, F.col("_handed").alias("_entry"))
        if changed.isEmpty():
            break
    ready = _sorted(same_keys(cut, F.broadcast(entries), keys + [SEG], "inner"), keys, order)
    return ready.mapInArrow(runner(True), _with(ready.schema, out)).drop(SEG, NEW, "_entry")


def _arrow(field: T.StructField) -> pa.DataType:
    kinds = {T.DoubleType: pa.float64(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BooleanType: pa.bool_(), T.StringType: pa.string()}
    return kinds[type(field.dataType)]
