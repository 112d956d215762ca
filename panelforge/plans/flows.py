"""Queries on sources and sinks, feature blocks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A, ordered as O, ranking as K, windows as N
from ..operators.registry import Registry
from ..sources import files as IO, sensors as SE
from ..streaming import state as ST
from .catalog import Tables, query
from .panel import EV, U, UO, W_EV, log


@query("csv_round_trip", "S1 S2 S3 S7 S8 S11", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderkey % 4 = 0 AS flag FROM orders""")
def csv_round_trip(t):
    src, dst = IO.scratch(t.spark, "csv"), IO.scratch(t.spark, "parquet")
    IO.export_csv(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", (F.col("o_orderkey") % 4 == 0).alias("flag")), src, 4)
    return IO.convert(t.spark, f"{src}/*.csv", dst, "o_orderkey bigint, o_custkey int, o_orderstatus string, o_totalprice double, flag boolean")


@query("stored_tables", "S9 S10", """
WITH c AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice / 1000) AS total FROM orders GROUP BY 1)
SELECT n, count(*) AS customers, avg(total) AS mean_total FROM c GROUP BY 1""", "mean_total")
def stored_tables(t):
    """Two steps of SQL, each stored as a table that the next one reads."""
    per = IO.run_sql(t.spark, "SELECT o_custkey, count(*) AS n, sum(o_totalprice / 1000) AS total FROM {o} GROUP BY 1", {"o": t.orders},
                     "customer_totals", IO.scratch(t.spark, "customer_totals"))
    return IO.run_sql(t.spark, "SELECT n, count(*) AS customers, avg(total) AS mean_total FROM {p} GROUP BY 1", {"p": per},
                      "total_counts", IO.scratch(t.spark, "total_counts"))


@query("yearly_files", "S4", """
SELECT o_custkey AS key, y AS year, count(o_orderkey) FILTER (year(o_orderdate) = y)::DOUBLE AS n FROM orders, (SELECT DISTINCT year(o_orderdate) AS y FROM orders) v GROUP BY 1, 2
UNION ALL SELECT DISTINCT o_custkey, (SELECT max(year(o_orderdate)) + 1 FROM orders), NULL FROM orders""", ints="year")
def yearly_files(t):
    paths = {}
    years = sorted(r[0] for r in t.orders.select(F.year("o_orderdate")).distinct().collect())  # a file each
    for y in years:
        per = t.orders.groupBy("o_custkey").agg(F.count_if(F.year("o_orderdate") == y).alias("n"))
        rows = per.select(F.concat(F.lit("0500000US"), F.col("o_custkey").cast("string")).alias("GEO_ID"), F.col("n").cast("string").alias("n"))
        second = t.spark.createDataFrame([("Geography", "Number of orders")], "GEO_ID string, n string")
        paths[y] = IO.scratch(t.spark, f"year{y}")
        IO.export_csv(second.unionByName(rows), paths[y])
    return IO.read_yearly(t.spark, paths, "n", blank_years=[years[-1] + 1])


@query("fold_files", "S16 S17", """
SELECT o_orderkey, o_totalprice, 'valid' AS part FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 2 = 0""")
def fold_files(t):
    path = IO.scratch(t.spark, "folds")
    o = t.orders.select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 3).alias("fold"), F.when(F.col("o_orderkey") % 2 == 0, "valid").otherwise("train").alias("part"))
    IO.write_folds(o, "fold", path, "part")
    picked = t.spark.read.parquet(path).filter("fold = 1 AND part = 'valid'").select("o_orderkey", "o_totalprice", "part")
    out = IO.scratch(t.spark, "submission")
    IO.write_submission(picked, out, ["o_orderkey", "part"], "o_totalprice")
    return IO.read_csv(t.spark, out, "o_orderkey bigint, part string, o_totalprice double")


@query("feature_blocks", "S18 S19 U5", """
SELECT o_custkey, avg(o_totalprice / 1000) AS price_mean, max(o_totalprice / 1000) AS price_max, count(*) AS n FROM orders GROUP BY 1""", "price_mean price_max", digits=9)
def feature_blocks(t):
    reg = Registry("o_custkey")

    @reg.block
    def sizes(df):
        return df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))

    @reg.block
    def prices(df):
        return df.groupBy("o_custkey").agg(F.avg("price").alias("price_mean"), F.max("price").alias("price_max"))

    store = IO.scratch(t.spark, "blocks").rsplit("-", 1)[1]
    return reg.build(t.orders.withColumn("price", F.col("o_totalprice") / 1000), store=store)


def _trace(t: Tables):
    """Events written as sensor text: a header line, and lines of one or two records."""
    e = log(t).withColumn("ms", F.floor(F.col("us") / 1000).cast("string"))
    mark = lambda kind, *cols: F.concat_ws("\t", "ms", F.lit(f"TYPE_{kind}"), *cols)
    v = F.col("value").cast("string")
    line = F.when(F.col("event_type") == "view", mark("WIFI", F.lit("net"), F.col("event_id").cast("string"), F.lit("-50"), F.lit("2412"), "ms")).when(
        F.col("event_type") == "click", F.concat(mark("WAYPOINT", v, v), mark("ACCELEROMETER", v, v, v, F.lit("3")))).otherwise(mark("WAYPOINT", v, v))
    path = IO.scratch(t.spark, "trace")
    head = e.filter("event_id = 0").select(F.lit("#\tstartTime:1704067200000\tsite:A").alias("value"))
    e.select(line.alias("value")).unionByName(head).write.text(f"{path}/siteA/F1")
    return path


@query("sensor_records", "S12 S13 S14", f"""
WITH {EV} SELECT kind, x, count(*) AS n, 'siteA' AS site, 'F1' AS floor FROM (
 SELECT 'waypoint' AS kind, value AS x FROM ev WHERE event_type <> 'view' UNION ALL SELECT 'accelerometer', value FROM ev WHERE event_type = 'click'
 UNION ALL SELECT 'wifi', event_id::DOUBLE FROM ev WHERE event_type = 'view') GROUP BY 1, 2
UNION ALL SELECT 'meta_startTime', 1704067200000::DOUBLE, 1, 'siteA', 'F1'""")
def sensor_records(t):
    path = _trace(t)
    r = SE.read_sensor_text(t.spark, path)
    parts = [r["waypoint"].select("path", "x", F.lit("waypoint").alias("kind")), r["accelerometer"].select("path", "x", F.lit("accelerometer").alias("kind")),
             r["wifi"].select("path", F.col("bssid").cast("double").alias("x"), F.lit("wifi").alias("kind"))]
    meta = SE.read_sensor_meta(t.spark, path).filter("key = 'startTime'").select("path", F.col("value").cast("double").alias("x"), F.lit("meta_startTime").alias("kind"))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(meta)
    both = SE.with_path_parts(both, ["site", "floor", "file"])
    return both.groupBy("kind", "x", "site", "floor").agg(F.count(F.lit(1)).alias("n"))


@query("map_boxes", "S15 F20", """
SELECT DISTINCT l_extendedprice - l_linenumber AS xmin, l_extendedprice + l_quantity AS xmax, -l_quantity AS ymin, l_linenumber + 0.5::DOUBLE AS ymax FROM lineitem""",
       "xmin xmax ymin ymax", digits=3)
def map_boxes(t):
    """A polygon per line item, written as a map file of one map per line."""
    x, y, q = F.col("l_extendedprice"), F.col("l_linenumber").cast("double"), F.col("l_quantity")
    ring = F.array(F.array(x - y, F.lit(0.25)), F.array(x, -q), F.array(x + q, y + 0.5), F.array(x, F.lit(0.0)))
    shape = F.struct(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    path = IO.scratch(t.spark, "maps")
    t.lineitem.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(shape).alias("features"))).alias("value")).write.text(path)
    d = SE.bbox(SE.read_geojson(t.spark, path, lines=True)).select("xmin", "xmax", "ymin", "ymax")
    return d.select(*[F.round(c, 3).alias(c) for c in d.columns]).distinct()


def event_stream(t: Tables):
    """The event table as a file stream, in the columns of ``log``."""
    raw = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.path)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return raw.select("event_id", "user_id", "event_type", "value", us.alias("us"), F.hour("ts").alias("hour"))


@query("stream_user_history", "X1", f"""
WITH {EV} SELECT user_id, event_id, us, count(*) OVER b AS past_count, avg(value) OVER b AS past_avg, stddev_pop(value) OVER b AS past_std,
 CASE WHEN lag(1, 6) OVER c IS NOT NULL THEN avg(value) OVER a END AS past_avg_5, lag(us, 1) OVER c - lag(us, 2) OVER c AS gap_0, lag(us, 2) OVER c - lag(us, 3) OVER c AS gap_1
FROM ev WINDOW c AS ({W_EV}), a AS ({W_EV} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b AS ({W_EV} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
       "past_avg past_std past_avg_5", "gap_0 gap_1", digits=9)
def stream_user_history(t):
    return _history_columns(ST.run_to_files(ST.user_history(event_stream(t), U, UO, "value", "us", [5], 2)))


_SLICES = "least(4, ((us - min(us) OVER ()) * 5) // (max(us) OVER () - min(us) OVER () + 1))"


@query("stream_late_answers", "X1", f"""
WITH {EV}, s AS (SELECT user_id, event_id, us, value, {_SLICES} AS b FROM ev),
n AS (SELECT *, row_number() OVER c AS i, sum(value) OVER c AS total FROM s WINDOW c AS ({W_EV})),
p AS (SELECT user_id, event_id, us, count(value) OVER e AS past_count, avg(value) OVER e AS past_avg, stddev_pop(value) OVER e AS past_std,
  lag(us, 1) OVER c - lag(us, 2) OVER c AS gap_0, lag(us, 2) OVER c - lag(us, 3) OVER c AS gap_1
  FROM s WINDOW c AS ({W_EV}), e AS (PARTITION BY user_id ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT p.*, CASE WHEN past_count > 5 THEN (hi.total - lo.total) / 5 END AS past_avg_5
FROM p LEFT JOIN n hi ON hi.user_id = p.user_id AND hi.i = p.past_count LEFT JOIN n lo ON lo.user_id = p.user_id AND lo.i = p.past_count - 5""",
       "past_avg past_std past_avg_5", "gap_0 gap_1", digits=9)
def stream_late_answers(t):
    """Events in five slices of time, each a micro-batch; the values of a slice arrive with the next one."""
    e = log(t).select("user_id", "event_id", "us", "value")
    ends = e.agg(F.min("us").alias("_lo"), F.max("us").alias("_hi"))  # one row
    part = F.least(F.lit(4), F.floor((F.col("us") - F.col("_lo")) * 5 / (F.col("_hi") - F.col("_lo") + 1))).cast("int")
    rows = ST.late_answers(O.attach(e, ends).withColumn("slice", part).drop("_lo", "_hi"), "slice", "value")
    return _history_columns(ST.replay(rows, "slice", lambda s: ST.user_history(s, U, UO, "value", "us", [5], 2, answer="late")))


def _history_columns(out):
    nul = lambda c: F.when(~F.isnan(c), F.col(c))
    return out.select("user_id", "event_id", "us", "past_count", nul("past_avg").alias("past_avg"), nul("past_std").alias("past_std"), nul("past_avg_5").alias("past_avg_5"),
                      nul("gap_0").cast("bigint").alias("gap_0"), nul("gap_1").cast("bigint").alias("gap_1"))


@query("stream_recent_values", "X2 X3", f"""
WITH {EV} SELECT user_id, event_id, list_reverse(list(value) OVER c) AS recent, max(value) OVER c - min(value) OVER c AS spread FROM ev WINDOW c AS ({W_EV} ROWS 3 PRECEDING)""", "spread")
def stream_recent_values(t):
    spread = lambda b: {"recent": b["value"][::-1].tolist(), "spread": float(b["value"].max() - b["value"].min())}
    s = ST.ring_buffer(event_stream(t), U, UO, "value", 4, spread, {"recent": "array<double>", "spread": "double"})
    return ST.run_to_files(s).drop("us")


_STAGE = ("night", "day", "evening")


@query("stream_stage_blocks", "X4", f"""
WITH g AS (SELECT user_id, value, CASE WHEN hour(ts) <= 7 THEN 'night' WHEN hour(ts) <= 17 THEN 'day' ELSE 'evening' END AS stage FROM events),
a AS (SELECT user_id, {', '.join(f"count(*) FILTER (stage = '{s}') AS {s}_n, sum(value) FILTER (stage = '{s}') AS {s}_sum" for s in _STAGE)} FROM g GROUP BY 1),
k AS (SELECT DISTINCT user_id, stage, CASE stage WHEN 'night' THEN 0 WHEN 'day' THEN 1 ELSE 2 END AS r FROM g)
SELECT user_id, stage, {', '.join(f"CASE WHEN r >= {i} THEN nullif({s}_n, 0) END AS {s}_n, CASE WHEN r >= {i} THEN {s}_sum END AS {s}_sum" for i, s in enumerate(_STAGE))} FROM k JOIN a USING (user_id)""",
       " ".join(f"{s}_sum" for s in _STAGE))
def stream_stage_blocks(t):
    from ..operators.splitting import stage_label

    e = event_stream(t).withColumn("stage", stage_label("hour", {"night": 7, "day": 17, "evening": 24}))
    out = ST.run_to_files(ST.stage_state(e, U, "stage", _STAGE, "value"))
    nul = {f"{s}_sum": F.when(~F.isnan(f"{s}_sum"), F.col(f"{s}_sum")) for s in _STAGE}
    return out.withColumns(nul)


@query("stream_scores", "X5 M13", """
SELECT event_id, value * 2 AS score FROM events""", "score")
def stream_scores(t):
    path = IO.scratch(t.spark, "scores")
    q = ST.score_batches(event_stream(t), lambda b: b.select("event_id", (F.col("value") * 2).alias("score")), "event_id", path)
    q.start().awaitTermination()
    return t.spark.read.parquet(path).select("event_id", "score")


@query("stream_from_saved_state", "X6", f"""
WITH {EV}, h AS (SELECT user_id, event_id, us, count(*) OVER b AS past_count, avg(value) OVER b AS past_avg, stddev_pop(value) OVER b AS past_std,
 CASE WHEN lag(1, 6) OVER c IS NOT NULL THEN avg(value) OVER a END AS past_avg_5, lag(us, 1) OVER c - lag(us, 2) OVER c AS gap_0, lag(us, 2) OVER c - lag(us, 3) OVER c AS gap_1
FROM ev WINDOW c AS ({W_EV}), a AS ({W_EV} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b AS ({W_EV} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT * FROM h WHERE event_id > (SELECT max(event_id) // 2 FROM events)""", "past_avg past_std past_avg_5", "gap_0 gap_1", digits=9)
def stream_from_saved_state(t):
    """History of the second half of the events, starting from the state of the first half."""
    e = log(t)
    half = e.agg(F.max("event_id").alias("m")).first()["m"] // 2
    state = ST.history_state(e.filter(F.col("event_id") <= half), U, UO, "value", "us", [5], 2)
    later = event_stream(t).filter(F.col("event_id") > half)
    return _history_columns(ST.run_to_files(ST.user_history(later, U, UO, "value", "us", [5], 2, initial=state)))
