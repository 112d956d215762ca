"""Queries on texts, dates, vectors and linear models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S, text as X
from ..operators import calendar as C, learning as L, ordered as O
from .catalog import Tables, query
from .panel import EV, K as SK, MO, SM, W_SM, log, supplier_month

STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


def spread(df):
    """Deal rows out when a table has fewer splits than the cluster has slots; work per text is heavy."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


@query("text_counts", "F1 F2", rf"""
SELECT doc_id, length(text) AS char_count, len({WORDS}) AS word_count, len(string_split(text, '.')) AS sentence_count, len(list_distinct({WORDS})) AS unique_words,
 len(regexp_extract_all(text, '"(.*?)"')) AS quoted, len(regexp_extract_all(text, '\.{{3,4}}')) AS dots FROM documents""")
def text_counts(t):
    return spread(t.documents).select("doc_id", *[c.alias(n) for n, c in X.text_counts("text").items()], X.quoted_count("text").alias("quoted"), X.dots_count("text").alias("dots"))


@query("text_char_classes", "F6 F7", rf"""
WITH w AS (SELECT doc_id, text, {WORDS} AS w FROM documents), s AS (SELECT *, list_sort(list_transform(w, lambda x: length(x))) AS n FROM w)
SELECT doc_id, len(regexp_extract_all(text, '[!-/:-@\[-`{{-~]')) AS punctuation, len(list_filter(w, lambda x: lower(x) IN ({STOP}))) AS stop_words,
 len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND x = upper(x))) AS upper_words, length(text) / (len(w) + 1) AS word_density,
 len(w) / len(string_split(text, '.')) AS words_per_sentence, coalesce(list_max(n), 0) AS longest_word, list_avg(n) AS word_len_mean, list_median(n) AS word_len_median FROM s""",
       "word_density words_per_sentence word_len_mean word_len_median", digits=9)
def text_char_classes(t):
    d = spread(t.documents).withColumn("w", X.words("text"))
    cols = X.char_class_counts("text", split=F.col("w")) | X.word_length_stats("text", F.col("w"))
    return d.select("doc_id", *[c.alias(n) for n, c in cols.items()])


@query("text_symbols", "F8", """
WITH s AS (SELECT doc_id, text, string_split(text, ' ') AS p FROM documents)
SELECT doc_id, """ + ", ".join(f"length(text) - length(replace(text, '{s}', '')) AS {n}" for s, n in X.SYMBOLS.items()) + """,
 len(list_distinct(p)) / len(p) AS diversity, list_max(list_transform(p, lambda x: length(x))) AS longest, list_avg(list_transform(p, lambda x: length(x))) AS mean_len FROM s""",
       "diversity mean_len", digits=9)
def text_symbols(t):
    return spread(t.documents).select("doc_id", *[c.alias(n) for n, c in X.symbol_counts("text").items()])


def pairs(t: Tables):
    """Each later turn of a conversation with the turn before it."""
    c = spread(t.conversations)
    first = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    return c.join(first, ["conv_id", "turn"])


@query("reply_overlap", "F3 F4 F5 U1", rf"""
WITH p AS (SELECT b.conv_id, b.turn, b.text, a.text AS prompt FROM conversations b JOIN conversations a ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
g AS (SELECT *, string_split(text, ' ') AS x, string_split(prompt, ' ') AS y FROM p),
n AS (SELECT *, list_transform(generate_series(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1]) AS x2, list_transform(generate_series(1, len(y) - 1), lambda i: y[i] || ' ' || y[i + 1]) AS y2,
 list_transform(generate_series(1, len(x) - 2), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2]) AS x3, list_transform(generate_series(1, len(y) - 2), lambda i: y[i] || ' ' || y[i + 1] || ' ' || y[i + 2]) AS y3 FROM g)
SELECT conv_id, turn, len(list_filter(regexp_extract_all(text, '"([^"]*)"', 1), lambda q: contains(prompt, q))) AS quotes,
 len(list_distinct(list_intersect(x2, y2))) AS bigrams, len(list_distinct(list_intersect(x3, y3))) AS trigrams,
 len(list_filter(list_distinct(list_intersect(string_split_regex(text, '\s+'), string_split_regex(prompt, '\s+'))), lambda w: w <> '' AND w NOT IN ({STOP}))) AS words FROM n""")
def reply_overlap(t):
    return pairs(t).select("conv_id", "turn", X.quotes_found("text", "prompt").alias("quotes"), X.ngram_overlap("text", "prompt", 2).alias("bigrams"),
                           X.ngram_overlap("text", "prompt", 3).alias("trigrams"), X.word_overlap("text", "prompt").alias("words"))


@query("readability_grades", "F9", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1)::DOUBLE AS s FROM documents WHERE text IS NOT NULL),
y AS (SELECT *, list_transform(w, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+'))
  - CASE WHEN regexp_matches(lower(x), '[^aeiouy]e$') AND NOT regexp_matches(lower(x), 'le$') THEN 1 ELSE 0 END, 1)) AS y FROM w),
t AS (SELECT doc_id, s, CASE WHEN len(w) > 0 THEN len(w)::DOUBLE END AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::DOUBLE AS chars, coalesce(list_sum(y), 0)::DOUBLE AS syl,
  len(list_filter(y, lambda x: x >= 3))::DOUBLE AS poly, len(list_filter(w, lambda x: length(x) > 6))::DOUBLE AS long FROM y)
SELECT doc_id, syl AS syllables, 4.71 * (chars / n) + 0.5 * (n / s) - 21.43 AS ari, 5.88 * (chars / n) - 29.6 * s / n - 15.8 AS coleman_liau, 1.043 * sqrt(poly * 30 / s) + 3.1291 AS smog,
  CASE WHEN (n + 2 * poly) / s > 20 THEN (n + 2 * poly) / s / 2 ELSE ((n + 2 * poly) / s - 2) / 2 END AS linsear, 0.39 * (n / s) + 11.8 * (syl / n) - 15.59 AS kincaid,
  206.835 - 1.015 * (n / s) - 84.6 * (syl / n) AS flesch, 0.4 * (n / s + 100 * poly / n) AS fog, n / s + 100 * long / n AS lix, long / s AS rix FROM t""",
       "syllables ari coleman_liau smog linsear kincaid flesch fog lix rix")
def readability_grades(t):
    return spread(t.documents).select("doc_id", *[c.alias(n) for n, c in X.readability("text").items()])


@query("cleaned_text", "F10 F11", rf"""
SELECT item_id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(text, '[^a-zA-Z]', ' ', 'g')), '\s+'), lambda w: w <> '' AND w NOT IN ({STOP})), ' ') AS cleaned,
 concat(item_id, ' | ', text) AS joined FROM benchmark""")
def cleaned_text(t):
    return t.benchmark.select("item_id", X.clean_text("text").alias("cleaned"), X.concat_text(["item_id", "text"], " | ").alias("joined"))


@query("calendar_attributes", "F13 F14", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT d, year(d) AS year, quarter(d) AS quarter, month(d) AS month, week(d) AS week, day(d) AS day, isodow(d) - 1 AS dayofweek, dayofyear(d) AS dayofyear,
 CAST(day(d) = 1 AS INT) AS is_month_start, CAST(last_day(d) = d AS INT) AS is_month_end, CAST(date_trunc('quarter', d) = d AS INT) AS is_quarter_start, CAST(day(d + 1) = 1 AND month(d) % 3 = 0 AS INT) AS is_quarter_end,
 CAST(dayofyear(d) = 1 AS INT) AS is_year_start, CAST(month(d) = 12 AND day(d) = 31 AS INT) AS is_year_end, CAST(isodow(d) > 5 AS INT) AS is_weekend,
 CAST(isodow(d) <= 5 AND NOT (month(d) = 1 AND day(d) = 1) AND NOT (month(d) = 12 AND day(d) = 25) AS INT) AS working FROM d""",
       ints="is_month_start is_month_end is_quarter_start is_quarter_end is_year_start is_year_end is_weekend working")
def calendar_attributes(t):
    d = t.orders.select(F.to_date("o_orderdate").alias("d")).distinct()
    d = d.withColumns(S.calendar_parts("d"))
    fixed = t.spark.createDataFrame([(m, x, r) for r in ("a",) for m, x in ((1, 1), (12, 25))], "month int, day int, region string")
    days = d.join(F.broadcast(fixed), ["month", "day"]).select("d", "region")
    return C.working_day(d.withColumn("region", F.lit("a")), "d", "region", days).drop("region")


@query("date_arithmetic", "F15 F16 F19", f"""
WITH {EV}, g AS (SELECT user_id, max(value * 1000 - event_id) AS gap FROM ev GROUP BY 1)
SELECT event_id, CAST(ts AS DATE) + 3 AS later, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days, floor(epoch(ts))::BIGINT AS sec,
 floor(us / 1e6 % 1000 * 25)::BIGINT AS frame, round(event_id + gap, 4) AS repaired FROM ev JOIN g USING (user_id)""")
def date_arithmetic(t):
    e = log(t).withColumn("seen", F.col("value") * 1000).withColumn("clock", F.col("event_id").cast("double"))
    e = C.repair_clock(e, "user_id", "clock", "seen", "repaired")
    return e.select("event_id", S.shift_days("ts", 3).alias("later"), S.days_between(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("days"), S.epoch("ts").alias("sec"),
                    S.time_to_frame(F.col("us") / 1e6 % 1000, 25).alias("frame"), F.round("repaired", 4).alias("repaired"))


@query("geometry", "F17 F21", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x, l_linenumber::DOUBLE AS y, l_tax * 100 AS u, l_discount * 100 AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sqrt(pow(x - u, 2) + pow(y - v, 2)) AS distance,
 CASE WHEN u <> 0 OR v <> 0 THEN acos(least(greatest((x * u + y * v) / nullif(sqrt(x * x + y * y) * sqrt(u * u + v * v), 0), -1), 1)) END AS angle,
 CASE WHEN abs(u / x) <= 1 THEN acos(u / x) END AS ratio_angle, (x + 0.5 * y) / (x + y + u) AS win_rate FROM p""", "distance angle ratio_angle win_rate", digits=5)
def geometry(t):
    l = t.lineitem
    x, y, u, v = F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_tax") * 100, F.col("l_discount") * 100
    cos = S.angle([x, y], [u, v])
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.distance([x, y], [u, v]).alias("distance"), cos.alias("angle"),
                    S.arccos_ratio(u, x).alias("ratio_angle"), S.win_rate(x, y, u).alias("win_rate"))


# scaling, projections, models


@query("scaled_columns", "L1 L2", """
SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS standard, (o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) AS minmax FROM orders""",
       "standard minmax")
def scaled_columns(t):
    o = t.orders.select("o_orderkey", F.col("o_totalprice").alias("standard"), F.col("o_totalprice").alias("minmax"))
    return L.minmax_scale(L.standard_scale(o, "standard"), "minmax")


@query("segment_regression", "L9", f"""
WITH {SM}, r AS (SELECT *, row_number() OVER ({W_SM})::DOUBLE AS i FROM sm)
SELECT l_suppkey, month, regr_intercept(qty, i) OVER k + regr_slope(qty, i) OVER k * i AS prediction FROM r WINDOW k AS (PARTITION BY l_suppkey)""", "prediction")
def segment_regression(t):
    d = O.positions(supplier_month(t), SK, MO, "i", split=None)
    return L.fit_by_segment(d, "l_suppkey", ["i"], "qty", alpha=0.0).select("l_suppkey", "month", "prediction")


@query("stacked_ridge", "L7", """
WITH b AS (SELECT o_orderkey, o_orderkey % 5 AS fold, o_totalprice / 100000 AS y, (o_custkey % 7)::DOUBLE AS x FROM orders),
s AS (SELECT f.fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM b, (SELECT DISTINCT fold FROM b) f WHERE b.fold <> f.fold GROUP BY 1),
c AS (SELECT fold, (sxy - sx * sy / n) / (sxx - sx * sx / n + 2) AS slope, sx / n AS mx, sy / n AS my FROM s)
SELECT o_orderkey, my - slope * mx + slope * x AS stacked FROM b JOIN c USING (fold)""", "stacked")
def stacked_ridge(t):
    b = t.orders.select("o_orderkey", (F.col("o_orderkey") % 5).alias("fold"), (F.col("o_totalprice") / 100_000).alias("y"), (F.col("o_custkey") % 7).cast("double").alias("x"))
    return L.stack_ridge(b, ["x"], "y", "fold", alpha=2.0).select("o_orderkey", "stacked")


@query("top_features", "L8", """
WITH f AS (SELECT p_brand AS feature, avg(p_retailprice) AS importance FROM part GROUP BY 1 UNION ALL SELECT p_brand, avg(p_size) FROM part GROUP BY 1)
SELECT feature, avg(importance) AS importance FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""", "importance")
def top_features(t):
    f = lambda c: t.part.groupBy(F.col("p_brand").alias("feature")).agg(F.avg(c).alias("importance"))
    return L.top_features([f("p_retailprice"), f("p_size")], 5)


@query("vector_pca", "L3")
def vector_pca(t):
    return L.pca(t.embeddings, "embedding", 4).select("vec_id", "pca")


@query("document_tfidf", "L4", f"""
WITH w AS (SELECT doc_id, {WORDS.replace('(text,', '(lower(text),')} AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS term FROM w),
c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
v AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 64),
r AS (SELECT doc_id, term, tf * idf AS x FROM c JOIN v USING (term))
SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM r""", "weight")
def document_tfidf(t):
    rows, _ = L.tfidf(spread(t.documents).select("doc_id", X.words(F.lower("text")).alias("w")), "doc_id", "w", (2, 3), 64)
    return rows


@query("customer_topics", "L5")
def customer_topics(t):
    from .baskets import baskets

    b = baskets(t).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    kinds = ["ECONOMY", "SMALL", "LARGE", "STANDARD", "PROMO", "MEDIUM"]
    c = b.groupBy("o_custkey").agg(*[F.count_if(F.col("p_type") == k).cast("double").alias(k) for k in kinds])
    return L.topics(c, kinds, 3, iterations=5).select("o_custkey", "topics")


def _factor_sql(steps, k):
    """The updates of ``nmf`` as one chain of CTEs over cells b(r, c, v)."""
    start = ", ".join(f"1 + ((7 * id + {3 * i}) % 11) / 11.0::DOUBLE AS f{i}" for i in range(k))
    out = [f"{x}0 AS MATERIALIZED (SELECT id, {start} FROM (SELECT DISTINCT {x} AS id FROM b))" for x in "rc"]

    def step(mine, other, own, their, name):
        top = ", ".join(f"sum(v * o.f{i}) AS t{i}" for i in range(k))
        gram = ", ".join(f"sum(f{i} * f{j}) AS g{i}_{j}" for i in range(k) for j in range(k))
        new = ", ".join(f"m.f{i} * t{i} / (1e-12 + {' + '.join(f'm.f{j} * g{j}_{i}' for j in range(k))}) AS f{i}" for i in range(k))
        return (f"{name} AS MATERIALIZED (SELECT m.id, {new} FROM {mine} m JOIN (SELECT b.{own} AS id, {top} FROM b JOIN {other} o ON b.{their} = o.id GROUP BY 1) t ON m.id = t.id, "
                f"(SELECT {gram} FROM {other}) g)")

    for i in range(steps):
        out.append(step(f"r{i}", f"c{i}", "r", "c", f"r{i + 1}"))
        out.append(step(f"c{i}", f"r{i + 1}", "c", "r", f"c{i + 1}"))
    return ", ".join(out)


@query("basket_factors", "L5", f"""
WITH b AS (SELECT l_suppkey AS r, l_partkey AS c, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1, 2), {_factor_sql(4, 3)}
SELECT * FROM r4""", "f0 f1 f2")
def basket_factors(t):
    return L.nmf(t.lineitem.withColumn("n", F.lit(1)), "l_suppkey", "l_partkey", "n", 3, iterations=4)[0]


@query("item_vectors", "L6")
def item_vectors(t):
    from ..operators import sequences as Q

    s = Q.sequences(log(t), ["user_id"], ["us", "event_id"], ["event_type"], 10_000)
    return L.item2vec(s, "event_type", 8)
