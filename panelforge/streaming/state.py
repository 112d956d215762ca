"""Stateful streams per key. Each has a batch twin of the same result.

State is a few numbers and a bounded tail per key. Within a micro-batch the rows of
a key are put in order; across micro-batches they must arrive in order.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import listed, same_keys
from ..sources.files import moved, scratch

NO_TIME = np.iinfo(np.int64).min  # a NULL among the times that are held
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(stream, keys, order, processor, out, initial=None):
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    grouped = stream.groupBy(*keys)
    state = initial.groupBy(*keys) if initial is not None else None
    return grouped.transformWithStateInPandas(processor, out, "append", "none", state)


def _in_order(pdf, order):
    """Rows in order; a stream calls this once per key and batch, so plain columns are sorted without ``sort_values``."""
    if len(pdf) < 2:
        return pdf
    cols = [pdf[c].to_numpy() for c in order]
    if any(c.dtype.kind not in "iufM" for c in cols):
        return pdf.sort_values(order, kind="stable")
    return pdf.take(np.lexsort(cols[::-1]))


class _Keyed(StatefulProcessor):
    """Orders the rows of a key and leaves the work to ``step``."""

    def __init__(self, keys, order):
        self.keys, self.order = keys, order

    def handleInputRows(self, key, rows, timerValues):
        parts = list(rows)
        pdf = _in_order(parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True), self.order)
        out = self.step(key, pdf)
        if out is not None and len(out):
            yield out

    def close(self):
        pass


def _past(n, mean, m2, x):
    """Count, mean and squared deviation before each new value, and after the last."""
    d = np.concatenate([[0.0], np.cumsum(x - mean)])
    q = np.concatenate([[0.0], np.cumsum((x - mean) ** 2)])
    count = n + np.arange(len(x) + 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        means = mean + np.where(count > 0, d / count, 0.0)
        spread = np.maximum(m2 + q - np.where(count > 0, d * d / count, 0.0), 0.0)
    return count, means, spread


class _History(_Keyed):
    def __init__(self, keys, order, value, time, ns, gaps, answer, resumed=False):
        super().__init__(keys, order)
        self.value, self.time, self.ns, self.gaps, self.answer, self.resumed = value, time, list(ns), gaps, answer, resumed
        self.reach = max([*self.ns, 0]) + 1

    def init(self, handle: StatefulProcessorHandle):
        self.state = handle.getValueState("history", "n bigint, mean double, m2 double, tail array<double>, times array<bigint>")

    def handleInitialState(self, key, initialState, timerValues):
        first = initialState.iloc[0]
        self.state.update((int(first["n"]), float(first["mean"]), float(first["m2"]), [float(v) for v in first["tail"]], [NO_TIME if pd.isna(v) else int(v) for v in first["times"]]))

    def step(self, key, pdf):
        n, mean, m2, tail, times = self.state.get() or (0, 0.0, 0.0, [], [])
        late = pdf[self.answer].to_numpy(bool) if self.answer else None
        given = pdf[self.value].to_numpy(float)
        known = ~np.isnan(given)
        learns = known if late is None else late & known  # rows that add a value
        asks = np.ones(len(pdf), bool) if late is None else ~late  # rows that want features
        x = given[learns]
        before = np.cumsum(learns) - learns  # values learnt earlier in this batch
        count, means, spread = _past(n, mean, m2, x)
        out = {c: pdf[c].array[asks] for c in [*self.keys, *self.order]}
        at = before[asks]
        total = count[at]
        out["past_count"] = total
        out["past_avg"] = np.where(total > 0, means[at], np.nan)
        out["past_std"] = np.where(total > 0, np.sqrt(spread[at] / np.maximum(total, 1)), np.nan)
        seen = np.concatenate([np.asarray(tail, float), x])
        ends = len(tail) + at
        for k in self.ns:
            full = total > k
            vals = np.full(len(at), np.nan)
            if full.any():
                means_k = np.lib.stride_tricks.sliding_window_view(seen, k).mean(axis=1)
                vals[full] = means_k[ends[full] - k]
            out[f"past_avg_{k}"] = vals
        given = pdf[self.time]
        t = (given.fillna(NO_TIME) if given.hasnans else given).to_numpy(np.int64)[asks]
        clock = np.concatenate([np.asarray(times, np.int64), t])
        for i in range(self.gaps):
            a = len(times) + np.arange(len(t)) - 1 - i
            ok = a >= 1  # none in the first row of a key, which may be its only one
            gap = np.full(len(t), np.nan)
            to, since = clock[a[ok]], clock[a[ok] - 1]
            timed = (to != NO_TIME) & (since != NO_TIME) | self.resumed  # gaps after saved state stay as they were
            gap[ok] = np.where(timed, to - since, np.nan)
            out[f"gap_{i}"] = gap
        self.state.update((int(count[-1]), float(means[-1]), float(spread[-1]), seen[-self.reach:].tolist(), clock[-(self.gaps + 1):].tolist()))
        return pd.DataFrame(out) if len(at) else None


def user_history(stream: DataFrame, keys, order, value, time, ns=(5, 10), gaps=3, answer=None, initial=None) -> DataFrame:
    """Count, mean and deviation of the earlier values of a key, means of its last n, gaps of its last times.

    With ``answer``, rows flagged by it bring the value of an earlier question and
    give no output, so a question's features hold only the answers that had arrived.
    ``initial`` starts from saved state (key, n, mean, m2, tail, times).
    """
    keys, order = listed(keys), listed(order)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    cols = [f"`{c}` {kinds[c]}" for c in [*keys, *order]] + ["past_count bigint", "past_avg double", "past_std double"]
    cols += [f"past_avg_{k} double" for k in ns] + [f"gap_{i} double" for i in range(gaps)]
    narrow = stream.select(*keys, *order, value, *[c for c in (time, answer) if c and c not in [*keys, *order, value]])
    # a NULL turns whole numbers into floats in pandas, which find no state of their key: states go by text without NULL
    texts = {f"_key{i}": F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for i, k in enumerate(keys)}
    initial = initial.withColumns(texts) if initial is not None else None
    return _stateful(narrow.withColumns(texts), list(texts), order, _History(keys, order, value, time, ns, gaps, answer, initial is not None), ", ".join(cols), initial)


def history_state(df: DataFrame, keys, order, value, time, ns=(5, 10), gaps=3) -> DataFrame:
    """State of ``user_history`` after a batch of rows, to start a stream from."""
    from ..operators.sequences import last_n

    keys = listed(keys)
    total = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))
    d = df.withColumns({"tail": F.col(value).cast("double"), "times": F.col(time).cast("bigint")})
    tail = last_n(d, keys, order, ["tail"], max([*ns, 0]) + 1)
    return same_keys(same_keys(total, tail, keys, "inner"), last_n(d, keys, order, ["times"], gaps + 1), keys, "inner")


class _Buffer(_Keyed):
    def __init__(self, keys, order, cols, n, fn, outputs):
        super().__init__(keys, order)
        self.cols, self.n, self.fn, self.outputs = cols, n, fn, outputs

    def init(self, handle):
        self.state = handle.getValueState("buffer", ", ".join(f"`{c}` array<double>" for c in self.cols))

    def step(self, key, pdf):
        held = self.state.get() or [[] for _ in self.cols]
        full = {c: np.concatenate([np.asarray(h, float), pdf[c].to_numpy(float)]) for c, h in zip(self.cols, held)}
        old = len(held[0])
        results = []
        for i in range(len(pdf)):
            end = old + i + 1
            results.append(self.fn({c: v[max(0, end - self.n):end] for c, v in full.items()}))
        self.state.update(tuple(v[-self.n:].tolist() for v in full.values()))
        out = pdf[[*self.keys, *self.order]].reset_index(drop=True)
        for name in self.outputs:
            out[name] = [r[name] for r in results]
        return out


def ring_buffer(stream, keys, order, cols, n, fn: Callable[[dict], dict], outputs: dict[str, str]) -> DataFrame:
    """Keep the last n rows per key and give ``fn`` of the buffer for each new row.

    ``fn`` gets one array per column, oldest first, the new row last.
    """
    keys, order, cols = listed(keys), listed(order), listed(cols)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out = [f"`{c}` {kinds[c]}" for c in [*keys, *order]] + [f"{k} {v}" for k, v in outputs.items()]
    return _stateful(stream.select(*dict.fromkeys([*keys, *order, *cols])), keys, order, _Buffer(keys, order, cols, n, fn, list(outputs)), ", ".join(out))


def last_n_state(stream, keys, order, col, n) -> DataFrame:
    """For each row the last n values of the key up to it, newest first."""
    return ring_buffer(stream, keys, order, [col], n, lambda b: {"recent": b[col][::-1].tolist()}, {"recent": "array<double>"})


class _Stages(_Keyed):
    def __init__(self, keys, stage, stages, value):
        super().__init__(keys, [])
        self.stage, self.stages, self.value = stage, stages, value

    def init(self, handle):
        self.state = handle.getMapState("stages", "stage string", "n bigint, total double")

    def handleInputRows(self, key, rows, timerValues):
        new: dict = {}
        for pdf in rows:  # sums only, so no order is needed
            for s, part in pdf.groupby(self.stage)[self.value]:
                n, total = new.get(s, (0, 0.0))
                new[s] = (n + len(part), total + float(part.sum()))
        held = {}
        for s in self.stages:
            got = self.state.getValue((s,)) if self.state.containsKey((s,)) else (0, 0.0)
            add = new.get(s, (0, 0.0))
            held[s] = (int(got[0]) + add[0], float(got[1]) + add[1])
            if s in new:
                self.state.updateValue((s,), held[s])
        lines = []
        for i, s in enumerate(self.stages):
            if held[s][0] and any(x in new for x in self.stages[: i + 1]):
                line = dict(zip(self.keys, key), **{self.stage: s})
                for j, v in enumerate(self.stages):
                    n, total = held[v] if j <= i and held[v][0] else (None, None)
                    line |= {f"{v}_n": n, f"{v}_sum": total}
                lines.append(line)
        if lines:
            out = pd.DataFrame(lines)
            for v in self.stages:
                out[f"{v}_n"] = out[f"{v}_n"].astype("Int64")
                out[f"{v}_sum"] = out[f"{v}_sum"].astype(float)
            yield out


def stage_state(stream, keys, stage, stages, value) -> DataFrame:
    """Count and sum per stage, each stage also carrying those of the earlier stages.

    A row is given again whenever its own or an earlier stage changes.
    """
    keys = listed(keys)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    cols = [f"`{c}` {kinds[c]}" for c in [*keys, stage]] + [f"{v}_n bigint, {v}_sum double" for v in stages]
    return _stateful(stream.select(*keys, stage, value), keys, [], _Stages(keys, stage, list(stages), value), ", ".join(cols))


def score_batches(stream, fn: Callable[[DataFrame], DataFrame], rid, path, checkpoint=None):
    """Score every micro-batch with ``fn``, check that it returns each id once, and only then publish it.

    A batch is staged in a folder that readers of ``path`` do not see. A replayed batch overwrites its own
    folders, so each is published once.
    """
    from ..operators.metrics import validate_batch

    def run(batch: DataFrame, epoch: int):
        staged = f"{path}/_staged/{epoch}"
        fn(batch).write.mode("overwrite").parquet(staged)
        made = batch.sparkSession.read.parquet(staged)
        found = validate_batch(made, batch, rid).first()
        if found["missing"] or found["unexpected"] or found["repeated"]:
            raise ValueError(f"batch {epoch}: {found.asDict()}")
        made.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint or scratch(stream.sparkSession, "scores"))
    return writer.trigger(availableNow=True)


def _to_files(stream, path, checkpoint):
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def run_to_files(stream, path=None, checkpoint=None) -> DataFrame:
    """Run a stream over all input there is and give its output; the checkpoint carries the state to the next run."""
    spark = stream.sparkSession
    path, checkpoint = path or scratch(spark, "stream"), checkpoint or scratch(spark, "checkpoint")
    _to_files(stream, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def late_answers(df: DataFrame, batch: str, value: str, answer: str = "late") -> DataFrame:
    """Rows as a stream brings them: each without its ``value`` in its own batch, and with it, flagged, in the next one.

    ``user_history`` with ``answer`` reads them; the keys' order puts answers before the rows of the later batch.
    """
    kind = df.schema[value].dataType
    asked = df.withColumns({value: F.lit(None).cast(kind), answer: F.lit(False)})
    return asked.unionByName(df.withColumns({batch: F.col(batch) + 1, answer: F.lit(True)}))


def replay(df: DataFrame, batch: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Output of the stream ``make(source)`` when the rows arrive batch by batch, lowest number first.

    One run of the stream reads them all: a run each would leave its state stores open on the executors beside
    those of the next. The rows are written once, a folder for each batch; when the batch before is done, the folder
    is moved into the source's in one step of the file system and read as one micro-batch. Rows without a batch
    number are left out. The driver sees the numbers and folders only, of which there are few.
    """
    spark = df.sparkSession
    kept, source, out, checkpoint = (scratch(spark, n) for n in ("kept", "source", "stream", "checkpoint"))
    df.filter(F.col(batch).isNotNull()).withColumn("_arrives", F.col(batch)).write.partitionBy("_arrives").parquet(kept)
    read = lambda reader, path: reader.schema(df.schema).option("recursiveFileLookup", True).parquet(path)
    parts = read(spark.read, kept)  # a table without rows leaves no file to read it from
    folders = {unquote(f).split("/")[-2] for f in parts.inputFiles()}
    numbers = spark.createDataFrame([(f, unquote(f.split("=", 1)[1])) for f in sorted(folders)], "at string, number string")
    number = F.col("number").cast(df.schema[batch].dataType).alias("number")
    batches = numbers.groupBy(number).agg(F.collect_list("at").alias("at")).orderBy("number").collect()
    if batches:
        moved(spark, [], source)
    else:
        parts.limit(0).write.parquet(source)
    q = _to_files(make(read(spark.readStream, source)), out, checkpoint).start()
    try:
        for i, r in enumerate(batches):
            moved(spark, [f"{kept}/{at}" for at in r["at"]], f"{kept}/next{i}")  # 0.0 and -0.0 have one each
            moved(spark, [f"{kept}/next{i}"], source)
            q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(out)
