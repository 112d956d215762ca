"""Jaccard join of documents on word shingles, by prefix filters under several global token orders.

Two sets of similarity t or more share a token among the first |x| - ceil(t |x|) + 1 tokens of each, under any
order of all tokens. The first order puts rare shingles first; it makes candidates. Each other order is a
further test that a candidate pair must pass before its sets are compared in full.

* Documents with equal sets are one class, known by the set's fingerprint; only classes are compared.
* The first order is (front, frequent, number of classes, hash). Front shingles are the FRONT share with the
  lowest hashes; only their counts are needed, as a prefix is shorter than that. Counts come from one exchange
  of packed arrays, cut by hash. A shingle that a bounded sample shows to be frequent is not counted: it goes
  after all counted ones. Any list of frequent shingles gives the same links; it steers balance only.
* Classes whose prefix has only shingles of their own drop out: with rare shingles first, most do. The texts of
  the others are read again, and the second order, (frequent, number of classes left, hash) over whole sets,
  makes an index in the same way. Further orders are scrambles of the hash, frequent shingles last.
* Candidates share a prefix shingle in the index, in the first order and in each further order, before their
  sets are compared. They are made in two rounds, so a large group of near copies does not meet itself in pairs.
  First each class meets one class of each of its buckets, the one with the fewest shingles before the shared
  one: in a group of near copies the least changed. Verified links give components. Then only classes outside a
  bucket's largest component meet the classes of its other components. A link joins two components or lies in one.
  ``links`` makes the candidates of each bucket instead, all of them, in salted blocks; its work grows with the links.
* A class whose shared shingle stands at place i of n can reach the similarity only with sets of at most
  (n - i) (100 + t) / t - n shingles; rows without such a partner in their bucket are left out before pairing.

Shingles and sets are 64-bit hashes. A wrong link takes two colliding ones: about 2 ** -64 for each pair compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from panelforge.session import stored

from .bitmaps import perhaps_in
from .components import components
from .registry import query, table
from .texts import coded_words, free_name, slices

WORDS, NEAR, OUT_OF = 5, 80, 100
FRONT = 0.4
ORDERS = 3
SAMPLE_DOCS, SAMPLE_LEAST = 5_000, 3
PART_SHINGLES = 1 << 19
CHUNK_SHINGLES = 1 << 18
BLOCK_CLASSES = 512
PART_BYTES = 1 << 20
SEEN = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted different hashes of its shingles of ``words`` words, A-Z in lower case.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    for part in slices(texts):
        codes, starts, names = coded_words(pc.ascii_lower(part))
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in names.to_pylist()], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
        rows = max(0, len(hashes) - words + 1)
        rolled = np.full(rows, np.uint64(words))
        for i in range(words):
            rolled = rolled * _STEP + hashes[i : i + rows]
        rolled = mixed(rolled)
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                h = np.full(1, np.uint64(b - a))
                for w in hashes[a:b]:
                    h = h * _STEP + w
                yield mixed(h)
            else:
                yield np.zeros(0, np.uint64)


def prefix_size(n, near: int = NEAR):
    """Tokens of a set of ``n`` that must meet: n - ceil(near * n / 100) + 1, in whole numbers."""
    return n - -(-near * n // OUT_OF) + 1


def later_prefix(tokens: np.ndarray, order: int, frequent: np.ndarray, near: int) -> np.ndarray:
    """The prefix under one of the further orders: frequent shingles last, else by another scramble."""
    key = mixed(tokens + np.uint64(int(_STEP) * order % 2**64))
    return tokens[np.lexsort((key, _among(tokens, frequent)))[: prefix_size(len(tokens), near)]]


def _among(tokens: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(tokens), bool)
    return held[np.minimum(np.searchsorted(held, tokens), len(held) - 1)] == tokens


def _parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The texts in parts of bounded size, so that what is made of them is bounded too."""
    for texts in batches:
        yield from slices(texts, PART_BYTES)
    _freed()


def _freed() -> None:
    """Give back what Arrow keeps: a worker stays alive for other tasks, beside others."""
    pa.default_memory_pool().release_unused()


def _fingerprint(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def frequent_shingles(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Sorted shingles of at least SAMPLE_LEAST rows among about SAMPLE_DOCS rows drawn by hash; ``docs``: (loc, text)."""

    def hashes(texts: pa.Array) -> pa.Array:
        sets = list(shingle_sets(texts, words))
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = _signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    step = max(1, docs.count() // SAMPLE_DOCS)
    drawn = docs.filter(F.pmod("loc", F.lit(step)) == 0)
    each = drawn.select("loc", F.explode(arrow_udf(hashes, T.ArrayType(T.LongType()))("text")).alias("token"))
    found = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("loc").alias("lo"), F.max("loc").alias("hi"))
    often = found.filter((F.col("n") >= SAMPLE_LEAST) & (F.col("lo") < F.col("hi"))).select("token").toPandas()["token"]
    return np.sort(often.to_numpy(np.int64).view(np.uint64))


FIRST = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n_front", T.LongType()),
    T.StructField("front", T.BinaryType()), T.StructField("rest", T.BinaryType()),
])


def _first_order(words: int, near: int, held):
    """n, fp, the number of front shingles, those that are counted, and the frequent and later ones the prefix may need."""
    cut = np.uint64(int(FRONT * 2**64))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        frequent = held.value
        for texts in _parts(batches):
            n, fp, n_front, front, rest = [], [], [], [], []
            for tokens in shingle_sets(texts, words):
                size = int(np.searchsorted(tokens, cut))
                mine, often = tokens[:size], _among(tokens[:size], frequent)
                more = max(0, prefix_size(len(tokens), near) - size) if len(tokens) else 0
                n.append(len(tokens)), fp.append(_fingerprint(tokens)), n_front.append(size)
                front.append(mine[~often]), rest.append(np.concatenate([mine[often], tokens[size : size + more]]))
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(n_front, pa.int64()), _binary(front), _binary(rest)],
                ["n", "fp", "n_front", "front", "rest"],
            )

    return arrow_udf(run, FIRST).asNondeterministic()


def _packed(parts: int, share: float):
    """Rows (part, tokens, fps): the counted shingles cut by hash; copies of a set within a task are left out."""
    width = min(int(share * 2**64) // parts + 1, 2**64 - 1)

    def emit(tokens: list[np.ndarray], fps: list[int]) -> pa.RecordBatch:
        token = np.concatenate(tokens)
        fp = np.repeat(np.array(fps, np.int64), [len(t) for t in tokens])
        part = (token // np.uint64(width)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        token, fp, part = token[order], fp[order], part[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(cuts[1:], len(part))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[cuts], pa.int64()), _binary([token[a:b] for a, b in zip(cuts, ends)]), _binary([fp[a:b] for a, b in zip(cuts, ends)])],
            ["part", "tokens", "fps"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, fps, held, seen = [], [], 0, set()
        for batch in batches:
            for fp, front in zip(batch.column("fp").to_pylist(), batch.column("front")):
                if fp in seen:
                    continue
                if len(seen) >= SEEN:  # repeats that are let through are removed later
                    seen.clear()
                seen.add(fp)
                mine = np.frombuffer(front.as_buffer(), np.uint64)
                tokens.append(mine), fps.append(fp)
                held += len(mine)
                if held >= CHUNK_SHINGLES:
                    yield emit(tokens, fps)
                    tokens, fps, held = [], [], 0
        if held:
            yield emit(tokens, fps)
        tokens, fps = [], []
        _freed()

    return run


def _counted(group: pa.Table) -> pa.Table:
    """(fp, token, df) of the shingles that two classes or more have."""
    token = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("tokens")])
    fp = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in group.column("fps")])
    order = np.lexsort((fp, token))
    token, fp = token[order], fp[order]
    new = np.append(True, (token[1:] != token[:-1]) | (fp[1:] != fp[:-1]))
    token, fp = token[new], fp[new]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    df = np.repeat(np.diff(np.append(first, len(token))), np.diff(np.append(first, len(token))))
    many = df > 1
    return pa.table({"fp": pa.array(fp[many]), "token": pa.array(_signed(token[many])), "df": pa.array(df[many].astype(np.int64))})


def _indexer(near: int, share: float):
    """(fp, n, token, place): the shared shingles in the prefix, for each class with any."""

    cut = np.uint64(int(share * 2**64)) if share < 1 else None

    def rows(held: list[tuple]) -> pa.RecordBatch:
        fps, ns, tokens, owns = zip(*held)
        sizes = np.array([len(t) for t in tokens])
        places = np.arange(sizes.sum()) + np.repeat(np.array(owns) - (np.cumsum(sizes) - sizes), sizes)
        repeated = [np.repeat(np.array(x, np.int64), sizes) for x in (fps, ns)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*repeated, np.concatenate(tokens), places.astype(np.int64))], ["fp", "n", "token", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            shared = batch.column("shared")
            ends = shared.offsets.to_numpy()
            df, token = (shared.values.field(c).to_numpy() for c in ("df", "token"))
            for i, (fp, n, n_front) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("fp", "n", "n_front")])):
                rest = np.frombuffer(batch.column("rest")[i].as_buffer(), np.int64)
                of = slice(ends[i], ends[i + 1])
                often = len(rest) if cut is None else int(np.sum(rest.view(np.uint64) < cut))
                own = n_front - often - (ends[i + 1] - ends[i])  # front shingles of this class alone come first
                mine = np.concatenate([token[of][np.lexsort((token[of], df[of]))], rest])[: max(0, prefix_size(n, near) - own)]
                if len(mine):
                    held.append((fp, n, mine, own))
                    size += len(mine)
                if size >= CHUNK_SHINGLES:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)
        held = []
        _freed()

    return run


def _index(sets: DataFrame, share: float, near: int) -> DataFrame:
    """Index rows (fp, n, token, place, head) of the buckets that two classes or more are in.

    ``sets``: fp, n, n_front (shingles among the first ``share`` of all hashes), front (those that are counted)
    and rest (frequent ones, and later ones that the prefix may need). ``head`` is the class of a bucket with
    the lowest place.
    """
    total = sets.agg(F.coalesce(F.sum(F.length("front")), F.lit(0))).first()[0] // 8
    parts = max(1, math.ceil(total / PART_SHINGLES))
    packed = sets.select("fp", "front").mapInArrow(_packed(parts, share), "part bigint, tokens binary, fps binary")
    shared = packed.groupBy("part").applyInArrow(_counted, "fp bigint, token bigint, df bigint")
    by_class = shared.groupBy("fp").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
    # a class can go on only if it has a shared or frequent shingle, or a prefix that leaves the front
    one = sets.groupBy("fp").agg(F.min(F.struct("n", "n_front", "rest")).alias("x")).select("fp", "x.*")
    met = one.join(by_class, "fp", "left").filter((F.length("rest") > 0) | F.col("shared").isNotNull())
    empty = F.array().cast("array<struct<df:bigint,token:bigint>>")
    ready = met.select("fp", "n", "n_front", "rest", F.coalesce("shared", empty).alias("shared"))
    rows = stored(ready.mapInArrow(_indexer(near, share), "fp bigint, n bigint, token bigint, place bigint"))
    head = F.min(F.struct("place", F.xxhash64("fp").alias("h"), "fp", "n")).alias("head")
    crowd = rows.groupBy("token").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), head).filter("lo < hi")
    return stored(rows.join(crowd.select("token", "head"), "token"))


SETS = T.StructType([
    T.StructField("fp", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("front", T.BinaryType()), T.StructField("rest", T.BinaryType()),
    T.StructField("prefixes", T.ArrayType(T.ArrayType(T.LongType()))),
])


def _set_reader(words: int, near: int, orders: int, held):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        frequent = held.value
        for texts in _parts(batches):
            sets = list(shingle_sets(texts, words))
            often = [_among(s, frequent) for s in sets]
            later = [[_signed(np.sort(later_prefix(s, k, frequent, near))) for k in range(2, orders)] for s in sets]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([_fingerprint(s) for s in sets], pa.int64()), _binary(sets), _binary([s[~o] for s, o in zip(sets, often)]),
                    _binary([s[o] for s, o in zip(sets, often)]), pa.array(later, pa.list_(pa.list_(pa.int64()))),
                ],
                ["fp", "tokens", "front", "rest", "prefixes"],
            )

    return arrow_udf(run, SETS).asNondeterministic()


def _common(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([
        len(np.intersect1d(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), assume_unique=True))
        for a, b in zip(left, right)
    ], pa.int64())


def _verified(pairs: DataFrame, sets: DataFrame, near: int, orders: int) -> DataFrame:
    """Pairs (a, b) of classes that pass the other orders and then the full comparison.

    ``sets``: fp, n, tokens and the prefixes under the orders other than that of the index.
    """
    def of(side):
        return sets.select(F.col("fp").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "tokens", "prefixes")])

    light = pairs
    if orders > 1:
        for side in "ab":
            light = light.join(of(side).drop(f"{side}_tokens", f"{side}_n"), side)
        for k in range(orders - 1):
            light = light.filter(F.arrays_overlap(F.col("a_prefixes")[k], F.col("b_prefixes")[k]))
        light = light.select("a", "b")
    for side in "ab":
        light = light.join(of(side).drop(f"{side}_prefixes"), side)
    common = arrow_udf(_common, T.LongType()).asNondeterministic()
    compared = light.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("total"), common("a_tokens", "b_tokens").alias("common"))
    return compared.filter(F.col("common") * OUT_OF >= (F.col("total") - F.col("common")) * near).select("a", "b")


def _lengths(near: int):
    return F.least("a_n", "b_n") * OUT_OF >= F.greatest("a_n", "b_n") * near


def _indexed(docs: DataFrame, key: str, text: str, words: int, near: int, orders: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, sets, index): class of every row, the sets that may have links, and the buckets of the second order."""
    if not 67 <= near <= 100 or words < 1 or orders < 2:
        raise ValueError("near from 67 to 100 (a prefix has to fit in the front), at least one word and two orders")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), body.alias("text"), F.xxhash64(F.col(f"`{key}`"), body).alias("loc"))
    held = docs.sparkSession.sparkContext.broadcast(frequent_shingles(rows.select("loc", "text"), words))
    first = stored(rows.withColumn("x", _first_order(words, near, held)("text")).select("key", "loc", "x.*"))
    full = first.filter("n > 0")

    before = _index(full.select("fp", "n", "n_front", "front", "rest"), FRONT, near)
    one = full.groupBy("fp").agg(F.min(F.struct("loc", "n")).alias("x")).select("fp", "x.*")
    alive = stored(before.groupBy("fp").agg(F.collect_list("token").alias("own")).join(one, "fp"))
    likely = perhaps_in(rows.select("loc", "text"), alive, "loc", "likely").filter("likely")
    texts = likely.join(alive.select("loc"), "loc", "left_semi").groupBy("loc").agg(F.first("text").alias("text"))
    read = texts.select(_set_reader(words, near, orders, held)("text").alias("x")).select("x.*")
    prefixes = F.concat(F.array("own"), F.col("prefixes")).alias("prefixes")
    sets = stored(alive.select("fp", "n", "own").join(read.dropDuplicates(["fp"]), "fp").select("fp", "n", "tokens", "front", "rest", prefixes))
    index = _index(sets.select("fp", "n", F.col("n").alias("n_front"), "front", "rest"), 1.0, near)
    return first.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("fp").alias("class")), sets, index


def _most(near: int):
    """The largest set that a class can be similar to if the shared shingle is the first they share."""
    return F.expr(f"(n - place) * {OUT_OF + near} div {near} - n")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, near: int = NEAR, orders: int = ORDERS) -> tuple[DataFrame, DataFrame]:
    """(members, links). ``members``: key, n_shingles and class of every row of ``docs``; ``links``: pairs (a, b) of
    similar classes, enough of them to tie together all classes that links of any kind connect.

    Classes are fingerprints of equal sets. Rows without words have n_shingles 0 and a class that has no links.
    """
    members, sets, index = _indexed(docs, key, text, words, near, orders)
    stars = index.select(F.col("fp").alias("a"), F.col("n").alias("a_n"), F.col("head.fp").alias("b"), F.col("head.n").alias("b_n"))
    stars = stars.filter((F.col("a") != F.col("b")) & _lengths(near)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near_stars = stored(_verified(stars, sets, near, orders))
    tied = components(near_stars)

    placed = index.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select(
        "token", "fp", "n", F.coalesce("component", "fp").alias("component"), _most(near).alias("most"))
    held_by = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"), F.max("most").alias("most"))
    buckets = held_by.groupBy("token").agg(
        F.count(F.lit(1)).alias("components"), F.max_by("component", F.struct("c", "component")).alias("largest"), F.min("least").alias("least"), F.max("most").alias("widest"))
    fits = (F.col("most") >= F.col("least")) & (F.col("n") <= F.col("widest"))
    open_rows = stored(placed.join(buckets.filter("components > 1"), "token").filter(fits))

    def side(s, rows, *more):
        return rows.select("token", F.col("fp").alias(s), F.col("n").alias(f"{s}_n"), F.col("most").alias(f"{s}_most"), F.col("component").alias(f"{s}_in"), *more)

    reach = (F.col("a_n") <= F.col("b_most")) & (F.col("b_n") <= F.col("a_most"))
    once = (F.col("b_in") == F.col("largest")) | (F.col("a") < F.col("b"))
    pairs = side("a", open_rows.filter("component <> largest"), "largest").join(side("b", open_rows), "token").filter((F.col("a_in") != F.col("b_in")) & once & reach & _lengths(near))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return members, near_stars.unionByName(stored(_verified(pairs, sets, near, orders)))


def _candidates(index: DataFrame, near: int) -> DataFrame:
    """All pairs (a, b) that share a bucket and fit in length, once each; a block of a bucket meets one block at a time."""
    held = index.groupBy("token").agg(F.count(F.lit(1)).alias("c")).select("token", F.ceil(F.col("c") / BLOCK_CLASSES).cast("int").alias("blocks"))
    rows = index.join(held, "token").select("token", "fp", "n", _most(near).alias("most"), "blocks", F.pmod(F.xxhash64("fp", "token"), "blocks").cast("int").alias("block"))

    def side(s, i, j):
        return rows.select("token", F.col("fp").alias(s), F.col("n").alias(f"{s}_n"), F.col("most").alias(f"{s}_most"), i, j)

    block = F.col("block")
    left = side("a", block.alias("i"), F.explode(F.sequence(block, F.col("blocks") - 1)).alias("j"))
    right = side("b", F.explode(F.sequence(F.lit(0), block)).alias("i"), block.alias("j"))
    reach = (F.col("a_n") <= F.col("b_most")) & (F.col("b_n") <= F.col("a_most")) & _lengths(near)
    met = left.join(right, ["token", "i", "j"]).filter(((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & reach)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, near: int = NEAR, orders: int = ORDERS) -> tuple[DataFrame, DataFrame]:
    """(members, links) as in ``classes``, but with every pair (a < b) of similar classes, each once.

    A group of m similar texts has m (m - 1) / 2 links, and as many pairs are verified: this is for callers that
    need the links themselves; ``classes`` is enough for groups. Rows of one class are similar to each other
    without a link of their own.
    """
    members, sets, index = _indexed(docs, key, text, words, near, orders)
    return members, stored(_verified(_candidates(index, near), sets, near, orders))


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, near: int = NEAR, orders: int = ORDERS) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, class, and n_links, the number of other rows that are similar to it."""
    members, pairs = links(docs, key, text, words, near, orders)
    size = members.filter("n_shingles > 0").groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(size.withColumnRenamed("class", "b"), "b").groupBy("a").agg(F.sum("size").alias("others"))
    counted = size.join(others.withColumnRenamed("a", "class"), "class", "left").select("class", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(counted, "class", "left").select(key, "n_shingles", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, near: int = NEAR, orders: int = ORDERS) -> DataFrame:
    """One row per row of ``docs``: the key, n_shingles and component_id, the smallest key reachable by links.

    Rows link when their sets of ``words``-word shingles have a Jaccard similarity of ``near`` percent or more.
    Rows without words (NULL, empty or blank texts) have 0 shingles, no links, and their own key as component;
    so has a row whose group has no key but NULL. Repeated rows are in one group. An empty table gives no rows;
    other columns are left out.
    """
    members, links = classes(docs, key, text, words, near, orders)
    tied = components(links).select(F.col("node").alias("class"), "component")
    placed = members.join(tied, "class", "left").withColumn("root", F.coalesce("component", "class"))
    least = placed.filter("n_shingles > 0").groupBy("root").agg(F.min(key).alias("least"))
    known = placed.select(key, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).alias("root")).join(least, "root", "left")
    return known.select(key, "n_shingles", F.coalesce("least", key).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, near: int = NEAR, orders: int = ORDERS) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest key; columns unchanged.

    Rows without words are all kept. A group whose keys are all NULL keeps one row, and of repeated rows with
    the smallest key one stays; rows equal in key and text are told apart by their place in ``docs``, so a
    table that has such rows must be one read from files, which gives the same places each time.

    Rows to drop are few, so a bitmap of fixed size lets most rows pass without a shuffle of their texts.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    loc, at, hit = (free_name(docs, x) for x in ("loc", "row_at", "perhaps"))
    placed = docs.withColumns({loc: F.xxhash64(F.col(f"`{key}`"), body), at: F.monotonically_increasing_id()})
    order = F.struct(F.col(f"`{key}`").isNull().alias("no_key"), F.col(f"`{key}`").alias("key"), F.col(loc).alias("loc"), F.col(at).alias("at"))
    members, links = classes(placed.select(order.alias("row"), F.col(f"`{text}`").alias("text")), "row", "text", words, near, orders)
    tied = components(links).select(F.col("node").alias("class"), "component")
    rooted = members.filter("n_shingles > 0").join(tied, "class", "left").select("row", F.coalesce("component", "class").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("row").alias("kept"))
    gone = stored(rooted.join(kept, "root").filter("row <> kept").select(F.col("row.loc").alias("gone"), F.col("row.at").alias("gone_at"), (F.col("row.loc") == F.col("kept.loc")).alias("twin")))
    marked = perhaps_in(placed, gone.select(F.col("gone").alias(loc)), loc, hit)
    same = (F.col(loc) == F.col("gone")) & (~F.col("twin") | (F.col(at) == F.col("gone_at")))
    stay = marked.filter(~F.col(hit)).unionByName(marked.filter(hit).join(gone, same, "left_anti"))
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])


OP4_SQL = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM t
), class AS (SELECT g, min(doc_id) AS a, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
e AS (SELECT a, n, hash(unnest(g)) AS k FROM class),
common AS (SELECT x.a AS a, y.a AS b, x.n AS an, y.n AS bn, count(*) AS c FROM e x JOIN e y ON x.k = y.k AND x.a < y.a AND least(x.n, y.n) * 100 >= 80 * greatest(x.n, y.n) GROUP BY ALL),
link AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (an + bn - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, a FROM class UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM s LEFT JOIN class ON s.g = class.g LEFT JOIN comp USING (a)
"""


@query("op4_jaccard_join", OP4_SQL)
def op4(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents"))
